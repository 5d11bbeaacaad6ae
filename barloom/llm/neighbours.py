"""Most similar vectors for every vector: balanced posting lists.

Method: a bounded sample of each group gives its centroids by balanced hierarchical clustering;
they form a graph that a task searches in memory.  Graphs are rows, one a group, which meet the
vectors of their group in a cogroup; a large group is spread over many tasks.  Each vector is posted to its nearest lists, boundary
vectors to several; as a query it visits the lists whose centroid is not much farther than its
nearest one (distance-ratio pruning).  Posting lists are scanned with blocked matrix products;
a list that is larger than a block is spread over a grid of blocks, so none is dropped or capped.
Exact copies of a direction are one vector for the search and are expanded at the end.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.plans.skew import spread_lookup
from barloom.plans.storage import write_table

#: Vectors for a posting list to hold before replication, and the most centroids of a group (its graph has to fit a task).
LIST_SIZE = 256
MAX_CENTROIDS = 65_536
#: The centroids of a group are fitted on a sample of at most so many vectors, and of so many a centroid; every vector is indexed.
SAMPLE_MAX = 400_000
SAMPLE_A_CENTROID = 80
#: Vectors of a group that a task assigns to lists at a time.
ASSIGN_ROWS = 40_000
#: Rows of a table of sizes (four numbers each) that are broadcast.
BROADCAST_ROWS = 100_000
#: Members and queries of one block of a list.
BLOCK_ROWS = 16_384
GRAPH_DEGREE = 24
#: Centroids up to which the graph links true nearest neighbours; beyond it they are sought in near cells.
EXACT_GRAPH = 16_384


@dataclass
class Probing:
    """How many lists a vector is posted to and visits, and the distance ratios that prune both."""

    post_lists: int = 4
    post_ratio: float = 1.25
    visit_lists: int = 16
    visit_ratio: float = 1.5


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 4) -> np.ndarray:
    """Spherical k-means whose assignment is penalised by cluster size; returns unit centroids."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    load = np.zeros(len(c))
    for _ in range(rounds):
        own = np.empty(len(x), np.int64)
        for i in range(0, len(x), 8192):
            own[i : i + 8192] = (x[i : i + 8192] @ c.T - 0.05 * load).argmax(1)
        size = np.bincount(own, minlength=len(c))
        load = size / max(1.0, len(x) / len(c)) - 1
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        empty = size == 0
        total[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


class CentroidGraph:
    """Centroids with a neighbour graph, searched by best-first beams for a batch of vectors at once."""

    def __init__(self, sample: np.ndarray, centroids: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        centroids = max(1, min(centroids, len(sample)))
        k1 = max(1, int(round(centroids**0.5)))
        top = _kmeans(sample, k1, rng)
        own = np.concatenate([(sample[i : i + 8192] @ top.T).argmax(1) for i in range(0, len(sample), 8192)])
        parts, cell = [], []
        for j in range(len(top)):
            mine = sample[own == j]
            if len(mine):
                k = max(1, min(len(mine), round(centroids * len(mine) / len(sample))))
                parts.append(_kmeans(mine, k, rng))
                cell += [j] * len(parts[-1])
        self.centroids = np.concatenate(parts)
        cell = np.array(cell)
        near_cells = np.argsort(-(top @ top.T), axis=1)[:, : min(len(top), 12)]
        members = [np.flatnonzero(cell == j) for j in range(len(top))]
        n = len(self.centroids)
        degree = min(GRAPH_DEGREE, max(1, n - 1))
        self.graph = np.zeros((n, degree), np.int32)
        if n <= EXACT_GRAPH:
            for i in range(0, n, 1024):
                s = self.centroids[i : i + 1024] @ self.centroids.T
                s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
                best = np.argpartition(-s, degree - 1, axis=1)[:, :degree] if n > 1 else np.zeros((len(s), degree), int)
                self.graph[i : i + 1024] = best
        for j in range(len(top)) if n > EXACT_GRAPH else ():
            pool = np.concatenate([members[q] for q in near_cells[j]])
            mine = members[j]
            if not len(mine):
                continue
            s = self.centroids[mine] @ self.centroids[pool].T
            s[pool[None, :] == mine[:, None]] = -2
            take = min(degree, len(pool))
            best = np.argsort(-s, axis=1)[:, :take]
            self.graph[mine] = np.pad(pool[best], ((0, 0), (0, degree - take)), mode="wrap")
        self.entries = np.array([m[0] for m in members if len(m)], np.int32)

    def search(self, q: np.ndarray, width: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosine) of the ``width`` best centroids found for each row of ``q``, best first."""
        c, n = self.centroids, len(self.centroids)
        if n <= 4 * width:  # a handful of centroids is all neighbours
            s = q @ c.T
            ids = np.argsort(-s, axis=1)[:, :width].astype(np.int32)
            return ids, np.take_along_axis(s, ids, 1)
        beam_width, expand = width + 8, 4
        s0 = q @ c[self.entries].T
        first = np.argsort(-s0, axis=1)[:, :beam_width]
        ids = self.entries[first]
        sims = np.take_along_axis(s0, first, 1)
        pad = beam_width - ids.shape[1]
        if pad > 0:
            ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1)
            sims = np.pad(sims, ((0, 0), (0, pad)), constant_values=-9)
        todo = ids >= 0
        rows = np.arange(len(q))[:, None]
        for _ in range(rounds):
            score = np.where(todo, sims, -9)
            pick = np.argpartition(-score, expand - 1, axis=1)[:, :expand]
            live = np.take_along_axis(todo, pick, 1)
            if not live.any():
                break
            todo[rows, pick] = False
            frontier = np.where(live, np.take_along_axis(ids, pick, 1), -1)
            nxt = self.graph[np.maximum(frontier, 0)].reshape(len(q), -1)
            ok = np.repeat(live, self.graph.shape[1], axis=1)
            new = np.einsum("bkd,bd->bk", c[nxt], q, optimize=False)
            all_ids = np.concatenate((ids, np.where(ok, nxt, -1)), 1)
            all_sims = np.concatenate((sims, np.where(ok, new, -9)), 1)
            all_todo = np.concatenate((todo, ok), 1)
            # a centroid met again is dropped; the one in the beam, which may be done, stays
            order = np.argsort(all_ids, axis=1, kind="stable")
            sorted_ids = np.take_along_axis(all_ids, order, 1)
            again = np.zeros_like(sorted_ids, bool)
            again[:, 1:] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
            drop = np.zeros_like(again)
            np.put_along_axis(drop, order, again, 1)
            all_sims[drop] = -9
            keep = np.argpartition(-all_sims, beam_width - 1, axis=1)[:, :beam_width]
            ids, sims, todo = (np.take_along_axis(x, keep, 1) for x in (all_ids, all_sims, all_todo))
            todo &= sims > -9
        best = np.argsort(-sims, axis=1)[:, :width]
        return np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)


def _within(sims: np.ndarray, ratio: float, most: int) -> np.ndarray:
    """Lists whose distance is at most ``ratio`` times that of the nearest one."""
    d = np.sqrt(np.maximum(2 - 2 * sims, 0))
    ok = (d <= ratio * d[:, :1] + 1e-6) & (sims > -2)
    ok[:, most:] = False
    return ok


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str, group_col: str, dim: int) -> DataFrame:
    """(grp, id, unit): valid vectors as the bytes of ``dim`` float32 of unit length.

    Null, all-zero and wrongly long vectors, those with a null, NaN or infinity, and rows with a
    null id or group take no part.
    """

    def run(batches):
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            u = np.ascontiguousarray((x / np.where(norm > 0, norm, 1)).astype(np.float32))
            ok = pa.array(np.isfinite(x).all(1) & (norm[:, 0] > 0))
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(u), [None, pa.py_buffer(u.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), raw], ["grp", "id", "unit"]).filter(ok)

    vec = F.col(vec_col).cast("array<float>")
    good = F.col(id_col).isNotNull() & F.col(group_col).isNotNull() & (F.size(vec) == dim) & ~F.exists(vec, lambda v: v.isNull())
    return vectors.where(good).select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).cast("long").alias("id"), vec.alias("v")).mapInArrow(run, "grp string, id long, unit binary")


def _matrix(raw, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float32).reshape(-1, dim)


def _lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join with a written table of few rows a key: broadcast up to BROADCAST_ROWS of them, spread beyond."""
    n = right.limit(BROADCAST_ROWS + 1).count()
    if n == 0 and how == "left":
        return left.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name not in keys])
    return left.join(F.broadcast(right), keys, how) if n <= BROADCAST_ROWS else spread_lookup(left, right, keys, F.col("id"), how)


def _posted(reps: DataFrame, dim: int, probing: Probing, sample_max: int, list_size: int) -> DataFrame:
    """Rows of ``reps`` with ``lists`` (visited, nearest first) and ``posts`` (of how many of them the vector is a member)."""
    n = F.col("n")
    lists = F.least(F.ceil(n / list_size), F.lit(MAX_CENTROIDS))
    wanted = F.least(F.lit(sample_max), F.greatest(lists * SAMPLE_A_CENTROID, F.lit(2_000)))
    sizes = reps.groupBy("grp").agg(F.count("*").alias("n")).select("grp", lists.cast("int").alias("n_lists"), (wanted / n * 2**31).cast("long").alias("rate"), F.ceil(n / ASSIGN_ROWS).cast("int").alias("parts"))
    sizes = write_table(sizes, "sizes")
    known = _lookup(reps, sizes, ["grp"])

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        graph = CentroidGraph(_matrix(pdf["unit"], dim), int(pdf["n_lists"].iloc[0]))
        return pd.DataFrame({"grp": [key[0]], "graph": [pickle.dumps(graph, protocol=5)]})

    # a hash sample; the least hash of a group is in it even if chance passes a small group by
    hashed = known.withColumn("h", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2**31)))
    drawn = hashed.where(F.col("h") < F.col("rate")).select("grp", "unit", "n_lists")
    missed = sizes.join(drawn.select("grp").distinct(), "grp", "left_anti").select("grp")
    least = hashed.join(missed, "grp", "left_semi").groupBy("grp").agg(F.min_by(F.struct("unit", "n_lists"), "h").alias("x")).select("grp", "x.*")
    graphs = write_table(drawn.union(least).groupBy("grp").applyInPandas(fit, "grp string, graph binary"), "graphs")

    def assign(vectors: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"grp": [], "id": [], "unit": [], "is_query": [], "lists": [], "posts": []})
        search = pickle.loads(graph["graph"].iloc[0]).search
        asks = vectors["is_query"].to_numpy(bool)
        x = _matrix(vectors["unit"], dim)
        lists: list = [None] * len(x)
        posts = np.zeros(len(x), np.int32)
        for asking in (True, False):  # only queries visit more lists than they are posted to
            mine = np.flatnonzero(asks == asking)
            for at in range(0, len(mine), 2048):
                rows = mine[at : at + 2048]
                ids, sims = search(x[rows], max(probing.visit_lists, probing.post_lists) if asking else probing.post_lists)
                post = _within(sims, probing.post_ratio, probing.post_lists)
                both = post | _within(sims, probing.visit_ratio, probing.visit_lists) if asking else post
                posts[rows] = post.sum(1)
                for r, i, v in zip(rows, ids, both):
                    lists[r] = i[v]
        return vectors[["grp", "id", "unit", "is_query"]].assign(lists=lists, posts=posts)

    part = F.pmod(F.xxhash64("id", F.lit(9)), F.col("parts")).cast("int")
    split = known.select("grp", part.alias("part"), "id", "unit", "is_query").groupBy("grp", "part")
    copies_of = graphs.join(sizes, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "graph")
    return split.cogroup(copies_of.groupBy("grp", "part")).applyInPandas(assign, "grp string, id long, unit binary, is_query boolean, lists array<int>, posts int")


def _scan(dim: int, k: int, least: float | None):
    """The best ``k`` members of a block for each of its queries, or all members of at least the similarity."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        member, query = pdf["member"].to_numpy(bool), pdf["query"].to_numpy(bool)
        ids = pdf["id"].to_numpy(np.int64)
        x = _matrix(pdf["unit"], dim) if len(pdf) else np.zeros((0, dim), np.float32)
        m, m_ids, q, q_ids = x[member], ids[member], x[query], ids[query]
        out_q, out_m, out_s = [], [], []
        for i in range(0, len(q), 1024) if len(m) else ():
            s = q[i : i + 1024] @ m.T
            s[q_ids[i : i + 1024, None] == m_ids[None, :]] = -2
            if least is not None:
                a, b = np.nonzero(s >= least)
            else:
                take = min(k, len(m))
                b = np.argpartition(-s, take - 1, axis=1)[:, :take].ravel()
                a = np.repeat(np.arange(len(s)), take)
            v = s[a, b]
            ok = v > -2
            out_q.append(q_ids[i + a[ok]])
            out_m.append(m_ids[b[ok]])
            out_s.append(v[ok])
        if not out_q:
            return pd.DataFrame({"q": np.zeros(0, np.int64), "m": np.zeros(0, np.int64), "sim": np.zeros(0, np.float32)})
        return pd.DataFrame({"q": np.concatenate(out_q), "m": np.concatenate(out_m), "sim": np.concatenate(out_s)})

    return run


def _blocks(assigned: DataFrame, block_rows: int) -> DataFrame:
    """Rows of (grp, list) with a grid block each; oversized lists are split, their rows repeated along the other axis."""
    posted = assigned.select("grp", "id", "is_query", F.posexplode("lists").alias("pos", "list"), "posts")
    is_member = F.col("pos") < F.col("posts")
    sizes = posted.groupBy("grp", "list").agg(F.sum(is_member.cast("int")).alias("n_m"), F.sum(F.col("is_query").cast("int")).alias("n_q"))
    grid = sizes.where((F.col("n_m") > block_rows) | (F.col("n_q") > block_rows)).select(
        "grp", "list", F.ceil(F.greatest(F.col("n_m"), F.lit(1)) / block_rows).cast("int").alias("mb"), F.ceil(F.greatest(F.col("n_q"), F.lit(1)) / block_rows).cast("int").alias("qb")
    )
    rows = _lookup(assigned.select("grp", "id", "unit", "is_query", F.posexplode("lists").alias("pos", "list"), "posts"), write_table(grid, "grid"), ["grp", "list"], "left")
    mb, qb = F.coalesce("mb", F.lit(1)), F.coalesce("qb", F.lit(1))
    own_m, own_q = F.pmod(F.xxhash64("id"), mb), F.pmod(F.xxhash64("id", F.lit(1)), qb)
    member = is_member
    cells = F.when((mb == 1) & (qb == 1), F.array(F.struct(F.lit(0).alias("b"), member.alias("m"), F.col("is_query").alias("q")))).otherwise(
        F.concat(
            F.when(member, F.transform(F.sequence(F.lit(0), qb - 1), lambda j: F.struct((own_m * qb + j).cast("int").alias("b"), F.lit(True).alias("m"), F.lit(False).alias("q")))).otherwise(F.array().cast("array<struct<b:int,m:boolean,q:boolean>>")),
            F.when(F.col("is_query"), F.transform(F.sequence(F.lit(0), mb - 1), lambda j: F.struct((j * qb + own_q).cast("int").alias("b"), F.lit(False).alias("m"), F.lit(True).alias("q")))).otherwise(F.array().cast("array<struct<b:int,m:boolean,q:boolean>>")),
        )
    )
    rows = rows.withColumn("cell", F.explode(cells)).where("cell.m or cell.q")
    return rows.select("grp", "list", F.col("cell.b").alias("block"), "id", F.col("cell.m").alias("member"), F.col("cell.q").alias("query"), "unit")


def similar_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "vec", group_col: str = "index_name", *, dim: int = 64, k: int = 10, min_similarity: float | None = None,
    query_filter=None, probing: Probing | None = None, sample_max: int = SAMPLE_MAX, list_size: int = LIST_SIZE, block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Neighbours of each vector within its group: ``(links, classes)``.

    ``links``: ``grp, q, m, sim`` between class representatives; with ``min_similarity`` all found
    links of at least it (both directions), else the ``k`` best per query, ties by the smaller id.
    ``classes``: ``grp, id, rep`` for vectors that are exact copies of a direction (one row per
    member, only classes of two or more).  ``query_filter`` (a Column over ``id``) limits the
    queries, never the collection.  Invalid vectors (see :func:`unit_vectors`) are left out,
    repeated rows count once, an id may hold several vectors, and an empty collection gives no rows.
    """
    probing = probing or Probing()
    is_query = F.lit(True) if query_filter is None else F.coalesce(query_filter, F.lit(False))
    direction = write_table(unit_vectors(vectors, id_col, vec_col, group_col, dim), "units").withColumn("dir", F.md5("unit"))
    reps = direction.withColumn("wanted", is_query).groupBy("grp", "dir").agg(F.min("id").alias("id"), F.first("unit").alias("unit"), F.max("wanted").alias("is_query"), F.max("id").alias("hi"))
    reps = write_table(reps, "reps")
    assigned = write_table(_posted(reps, dim, probing, sample_max, list_size), "posted")
    found = _blocks(assigned, block_rows).groupBy("grp", "list", "block").applyInPandas(
        lambda key, pdf: _scan(dim, k, min_similarity)(pdf).assign(grp=key[0]), "grp string, q long, m long, sim float"
    )
    links = found.groupBy("grp", "q", "m").agg(F.max("sim").alias("sim"))
    if min_similarity is None:
        best = Window.partitionBy("grp", "q").orderBy(F.desc("sim"), "m")
        links = links.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
    return links, _classes(direction, reps)


def _classes(direction: DataFrame, reps: DataFrame) -> DataFrame:
    many = reps.where("hi > id").select("grp", "dir", F.col("id").alias("rep"))
    return spread_lookup(direction.select("grp", "dir", "id"), many, ["grp", "dir"], F.col("id")).select("grp", "id", "rep").distinct()


def copies(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "vec", group_col: str = "index_name", *, dim: int = 64) -> DataFrame:
    """The ``classes`` of :func:`similar_vectors` without a search."""
    units = unit_vectors(vectors, id_col, vec_col, group_col, dim)
    direction = write_table(units.select("grp", "id", F.md5("unit").alias("dir")), "directions")
    return _classes(direction, direction.groupBy("grp", "dir").agg(F.min("id").alias("id"), F.max("id").alias("hi")))


def by_asked_id(links: DataFrame, asked: DataFrame) -> DataFrame:
    """``grp, id, q, m, sim``: the links of each asked id, that of a class (``asked``: its ``grp, id, rep``) under its own id.

    A class without an asked member asks nothing, so a representative that isn't in ``asked`` is alone in its class.
    """
    links = write_table(links, "links")
    reps = asked.select("grp", F.col("rep").alias("q")).distinct()
    alone = links.join(reps, ["grp", "q"], "left_anti").withColumn("id", F.col("q"))
    within = spread_lookup(asked.select("grp", "id", F.col("rep").alias("q")), links, ["grp", "q"], F.col("id"))
    return within.select("grp", "id", "q", "m", "sim").union(alone.select("grp", "id", "q", "m", "sim"))


def similar_pairs(vectors: DataFrame, min_similarity: float, **kw) -> DataFrame:
    """All pairs ``(grp, a, b)`` of ids, a < b, of at least the similarity, copies expanded."""
    links, classes = similar_vectors(vectors, min_similarity=min_similarity, **kw)
    between = links.select("grp", F.least("q", "m").alias("q"), F.greatest("q", "m").alias("m")).distinct()
    side = lambda c, name: classes.select("grp", F.col("rep").alias(c), F.col("id").alias(name))
    wide = between.join(side("q", "qa"), ["grp", "q"], "left").join(side("m", "mb"), ["grp", "m"], "left")
    wide = wide.select("grp", F.coalesce("qa", "q").alias("a"), F.coalesce("mb", "m").alias("b"))
    inside = classes.select("grp", "rep", F.col("id").alias("a")).join(classes.select("grp", "rep", F.col("id").alias("b")), ["grp", "rep"]).select("grp", "a", "b")
    both = wide.union(inside).select("grp", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return both.where("a < b").distinct()
