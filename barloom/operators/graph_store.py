"""Generations of a stored graph: upserts, publication, journal, sweeps and health questions.

A store is a folder of Parquet: nodes and edges by ``generation``, claimed and published numbers, and a journal.
Tables: nodes (id, primitive, name, status, ...), edges (src, dst, relation, ...); rows that a
reseed wrote carry its number in ``reseed_seq``, rows proposed at run time null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.graph import RELATIONS, Graph
from barloom.plans.skew import spread_lookup
from barloom.plans.storage import write_table

#: Relations that must not close a circle, and the kinds of nodes.
ACYCLIC = ("kind-of", "part-of", "supersedes")
PRIMITIVES = ("Concept", "Procedure", "Module", "Property", "Principle")
#: Edges that one task may peel.
ONE_TASK = 50_000
NODE_KEY, EDGE_KEY = ["id"], ["src", "dst", "relation"]


def snapshot(df: DataFrame, key: list[str]) -> DataFrame:
    """``entity, sha``: a digest of each live row's content under its key; repeated rows count once.

    Deprecated rows are retired and left out, so that a retirement is journaled as invalidated;
    ``reseed_seq`` says who wrote a row and is no content.
    """
    if "status" in df.columns:
        df = df.where("status is null or status != 'deprecated'")
    body = [F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in sorted(df.columns) if c not in (*key, "reseed_seq")]
    return df.select(F.concat_ws("|", *key).alias("entity"), F.sha1(F.concat_ws("\u0001", *body)).alias("sha")).distinct()


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``entity, change``: generated, revised or invalidated, from two snapshots; what is unchanged gives no row."""
    both = before.withColumnRenamed("sha", "old").join(after.withColumnRenamed("sha", "new"), "entity", "full_outer")
    change = F.when(F.col("old").isNull(), "generated").when(F.col("new").isNull(), "invalidated").when(F.col("old") != F.col("new"), "revised")
    return both.select("entity", change.alias("change")).where("change is not null")


def sweep(nodes: DataFrame, edges: DataFrame, seq: int | None) -> tuple[DataFrame, DataFrame]:
    """What earlier reseeds wrote and reseed ``seq`` didn't: nodes become deprecated, edges are dropped.

    Rows that no reseed ever wrote (null ``reseed_seq``) stay as they are; without a number nothing is swept.
    """
    if not seq:
        return nodes, edges
    gone = F.col("reseed_seq").isNotNull() & (F.col("reseed_seq") != seq)
    return nodes.withColumn("status", F.when(gone, F.lit("deprecated")).otherwise(F.col("status"))), edges.where(~gone)


def upsert(old: DataFrame | None, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put over those of the same key; ``created_at`` keeps its first value."""
    names = [c for c in new.columns if c not in key]
    one = new.groupBy(*key).agg(F.max(F.struct(*names)).alias("n")).select(*key, "n.*") if names else new.distinct()
    if old is None:
        return one
    kept = old.join(one.select(*key), key, "left_anti")
    if "created_at" in one.columns and "created_at" in old.columns:
        first = old.groupBy(*key).agg(F.min("created_at").alias("first_seen"))
        one = one.join(first, key, "left").withColumn("created_at", F.coalesce("first_seen", "created_at")).drop("first_seen")
    return kept.unionByName(one, allowMissingColumns=True)


def circles(edges: DataFrame, relations: tuple[str, ...] = ACYCLIC) -> DataFrame:
    """``relation, src, dst`` of the edges that lie on a circle of their relation or lead from one to another.

    Edges whose end has no edge going on are taken off, and those whose start nothing leads to,
    until none is left or nothing changes.  A round is a job; what has become small enough for a
    task (ONE_TASK edges) is finished in one.
    """
    left = write_table(edges.where(F.col("relation").isin(*relations)).select("relation", "src", "dst").dropna().distinct(), "peeled")
    n = left.count()
    while n > ONE_TASK:
        kept = left.join(left.select("relation", F.col("src").alias("dst")).distinct(), ["relation", "dst"], "left_semi")
        kept = kept.join(left.select("relation", F.col("dst").alias("src")).distinct(), ["relation", "src"], "left_semi")
        left = write_table(kept.select("relation", "src", "dst"), "peeled")
        before, n = n, left.count()
        if n == before:
            return left
    return left.groupBy("relation").applyInPandas(_peel, "relation string, src string, dst string")


def _peel(pdf: pd.DataFrame) -> pd.DataFrame:
    """The edges of one relation that stay; each edge is taken off once, whatever the length of its chain."""
    n = len(pdf)
    codes, names = pd.factorize(pd.concat([pdf["src"], pdf["dst"]], ignore_index=True))
    keep = np.ones(n, bool)
    # what the second pass takes off leads out of nodes that nothing leads to, so the first needs no repeat
    for near, far in ((codes[:n], codes[n:]), (codes[n:], codes[:n])):
        on = np.bincount(near[keep], minlength=len(names))
        order = np.argsort(far, kind="stable")
        first = np.searchsorted(far[order], np.arange(len(names) + 1))
        todo = np.flatnonzero(on == 0).tolist()
        while todo:
            v = todo.pop()
            for i in order[first[v] : first[v + 1]]:
                if keep[i]:
                    keep[i] = False
                    on[near[i]] -= 1
                    if not on[near[i]]:
                        todo.append(near[i])
    return pdf.loc[keep, ["relation", "src", "dst"]]


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids without any edge."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes.select("id").distinct().join(ends, "id", "left_anti")


def reachable(edges: DataFrame, start: DataFrame, relations: list[str] | None = None, *, undirected: bool = False, max_depth: int | None = None) -> DataFrame:
    """``id, depth`` of what is reached from ``start`` (ids), itself at depth 0."""
    e = edges.where(F.col("relation").isin(relations)) if relations else edges
    steps = e.select(F.col("src").alias("id"), F.col("dst").alias("next"))
    if undirected:
        steps = steps.union(e.select(F.col("dst"), F.col("src")))
    steps = write_table(steps, "steps")
    seen = front = start.select("id").distinct().select("id", F.lit(0).alias("depth"))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = spread_lookup(steps, front.select("id"), ["id"], F.col("next"), "left_semi").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti")
        front = write_table(new.select("id", F.lit(depth).alias("depth")), "reach")
        if front.isEmpty():
            break
        seen = write_table(seen.unionByName(front), "reached") if depth % 8 == 0 else seen.unionByName(front)
    return seen


def disconnected(nodes: DataFrame, edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Ids that no anchor reaches in either direction."""
    return nodes.select("id").distinct().join(reachable(edges, anchors, undirected=True), "id", "left_anti")


def closes_circle(edges: DataFrame, src: str, dst: str, relation: str) -> bool:
    """Whether a new edge would close a circle of its relation."""
    start = edges.sparkSession.createDataFrame([(dst,)], "id string")
    return relation in ACYCLIC and not reachable(edges, start, [relation]).where(F.col("id") == src).isEmpty()


def _vocabulary(parents: DataFrame) -> list[tuple[str, str]]:
    rows = [(r["relation"], r["parent"]) for r in parents.select("relation", "parent").limit(10_001).collect()]
    if len(rows) > 10_000:
        raise ValueError("a relation vocabulary of more than 10,000 rows")
    return rows


def relation_descendants(parents: DataFrame, relation: str) -> list[str]:
    """A relation and its sub-relations from ``relation, parent`` (a vocabulary: its rows fit the driver)."""
    rows = _vocabulary(parents)
    out, todo = [], [relation]
    while todo:
        at = todo.pop()
        if at not in out:
            out.append(at)
            todo += [r for r, p in rows if p == at]
    return out


def relation_ancestors(parents: DataFrame, relation: str) -> list[str]:
    """From a relation up to its root, nearest first."""
    up, out = dict(_vocabulary(parents)), []
    while up.get(relation) and up[relation] not in out:
        relation = up[relation]
        out.append(relation)
    return out


def knowledge_nodes(nodes: DataFrame, status: str | None = None) -> DataFrame:
    """Nodes of a primitive, in the order of id."""
    rows = nodes.where("primitive is not null")
    return (rows.where(F.col("status") == status) if status is not None else rows).orderBy("id")


def nodes_by_primitive(nodes: DataFrame, primitive: str) -> DataFrame:
    if primitive not in PRIMITIVES:
        raise ValueError(f"unknown primitive {primitive!r}")
    return nodes.where(F.col("primitive") == primitive).orderBy("id")


def edges_by_relation(edges: DataFrame, relation: str, parents: DataFrame | None = None) -> DataFrame:
    """Edges of a relation and, with a vocabulary ``relation, parent``, of its sub-relations, in the order of their ends."""
    wanted = relation_descendants(parents, relation) if parents is not None else [relation]
    return edges.where(F.col("relation").isin(wanted)).orderBy("src", "dst", "relation")


def resolve(nodes: DataFrame, ref: str) -> list[str]:
    """Ids a reference may name: the id itself, else all of that name, else the twelve shortest that hold it (a path counts as a dotted name)."""
    part = ref.replace("/", ".").removesuffix(".py").lower()
    holds = F.contains(F.lower("id"), F.lit(part)) | F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit(part))
    rank = F.when(F.col("id") == ref, 1).when(F.col("name") == ref, 2).when(holds, 3)
    hits = write_table(nodes.select("id", rank.alias("rank")).where("rank is not null").distinct(), "resolved")
    best = hits.agg(F.min("rank")).first()[0]
    order = hits.where(F.col("rank") == best)
    return [r["id"] for r in (order.orderBy(F.length("id"), "id").limit(12) if best == 3 else order.orderBy("id")).collect()] if best else []


def search_index(graph: Graph) -> DataFrame:
    """``id, name, primitive, status, haystack``: the searchable text of each node in one column, best bands first."""
    return graph.haystacks().select("id", "name", "primitive", "status", F.concat_ws(" ", *[f"t{i}" for i in range(5)]).alias("haystack"))


def coverage(nodes: DataFrame, edges: DataFrame, primitives: list[str], relations: list[str]) -> DataFrame:
    """``what, declared, used, share`` of the vocabularies."""
    spark = nodes.sparkSession
    out = None
    for what, col, df, names in (("primitive", "primitive", nodes, primitives), ("relation", "relation", edges, relations)):
        declared = spark.createDataFrame([(n,) for n in names], f"{col} string")
        one = declared.join(df.select(col).distinct().withColumn("u", F.lit(1)), col, "left").agg(F.count("*").alias("declared"), F.count("u").alias("used"))
        one = one.select(F.lit(what).alias("what"), "declared", "used", (F.col("used") / F.col("declared")).alias("share"))
        out = one if out is None else out.union(one)
    return out


def impact(edges: DataFrame, ref: str, relations: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """``id, depth`` of everything that depends on a node: the closure against the direction of edges."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation")
    return reachable(turned, edges.sparkSession.createDataFrame([(ref,)], "id string"), relations, max_depth=max_depth).where("depth > 0")


def impact_zones(edges: DataFrame, ref: str, *, max_depth: int = 4) -> DataFrame:
    """``zone, id``: dependents, tests, policies and probable users of a node.

    Dependents lead to it over imports and contains, up to ``max_depth`` hops.  Tests are what tests
    the zone (the node and its dependents); guardrails implement what the zone contains; policies
    enforce any of these.  Probable users are modules outside the zone from which, over up to three
    ``contains``, something calls into what the zone or its classes contain.
    """
    of = lambda *r: edges.where(F.col("relation").isin(*r)).select("src", "dst")
    into = lambda e, ids: spread_lookup(e, ids.select(F.col("id").alias("dst")), ["dst"], F.col("src"), "left_semi").select(F.col("src").alias("id")).distinct()
    out = lambda e, ids: spread_lookup(e, ids.select(F.col("id").alias("src")), ["src"], F.col("dst"), "left_semi").select(F.col("dst").alias("id")).distinct()
    me = edges.sparkSession.createDataFrame([(ref,)], "id string")
    dependents = write_table(impact(edges, ref, ["imports", "contains"], max_depth).select("id"), "dependents")
    zone = me.union(dependents).distinct()
    classes = write_table(out(of("contains"), zone), "classes")
    tests = write_table(into(of("tests"), zone), "tests")
    guardrails = into(of("implements"), classes).where("id like 'guardrail:%'")
    policies = into(of("enforces"), tests.union(guardrails).union(zone).distinct())
    callers = into(of("calls"), out(of("contains"), classes.union(zone).distinct()))
    modules = callers.where("id like 'module:%'")
    for _ in range(4):
        callers = into(of("contains"), callers.where("id not like 'module:%'"))
        modules = modules.union(callers.where("id like 'module:%'"))
    parts = {"dependent": dependents.where("id not like 'test:%'"), "test": tests, "policy": policies, "probable_user": modules.distinct().join(zone, "id", "left_anti")}
    whole = [df.select(F.lit(name).alias("zone"), "id") for name, df in parts.items()]
    return whole[0].union(whole[1]).union(whole[2]).union(whole[3])


class GraphStore:
    """Generations under a folder; readers see the published one only."""

    def __init__(self, spark, path: str):
        self.spark, self.path, self.reseed_seq = spark, path.rstrip("/"), None

    def _fs(self, name: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _exists(self, name: str) -> bool:
        fs, place = self._fs(name)
        return fs.exists(place)

    def _numbers(self, name: str) -> list[int]:
        fs, place = self._fs(name)
        return [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(place) if "=" in s.getPath().getName()] if fs.exists(place) else []

    def _claim(self, name: str) -> int:
        """The next free number; of two writers that ask at once only one gets it."""
        n = max(self._numbers(name), default=0) + 1
        while True:
            fs, place = self._fs(f"{name}/n={n}")
            try:
                fs.create(place, False).close()
                return n
            except Exception as e:  # noqa: BLE001
                if not fs.exists(place):
                    raise e
                n += 1

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}") if self._exists(name) else self.spark.createDataFrame([], schema)

    def published(self) -> int:
        return self._read("published", "generation int").agg(F.max("generation").alias("g")).first()["g"] or 0

    def begin_generation(self) -> int:
        """A number of its own for each writer."""
        return self._claim("claimed")

    def mark_reseed(self) -> int:
        """Begin a reseed: what is written until :meth:`end_reseed` carries its number."""
        self.reseed_seq = self._claim("reseeds")
        return self.reseed_seq

    def end_reseed(self, generation: int) -> tuple[DataFrame, DataFrame]:
        """The nodes and edges of a generation without what the running reseed didn't write again."""
        seq, self.reseed_seq = self.reseed_seq, None
        return sweep(self.read("nodes", generation), self.read("edges", generation), seq)

    def write(self, generation: int, nodes: DataFrame, edges: DataFrame) -> None:
        """A whole generation; unknown kinds and relations, and circles of acyclic relations, are refused."""
        unknown = nodes.where(F.col("primitive").isNotNull() & ~F.col("primitive").isin(*PRIMITIVES)).select("primitive").first() if "primitive" in nodes.columns else None
        if unknown:
            raise ValueError(f"unknown primitive {unknown[0]!r}")
        unknown = edges.where(F.col("relation").isNotNull() & ~F.col("relation").isin(*RELATIONS)).select("relation").first()
        if unknown:
            raise ValueError(f"unknown relation {unknown[0]!r}")
        ring = circles(edges).first()
        if ring:
            raise ValueError(f"{ring['relation']} of {ring['src']} closes a circle")
        for name, df in (("nodes", nodes), ("edges", edges)):
            if self.reseed_seq is not None:
                df = df.withColumn("reseed_seq", F.lit(self.reseed_seq))
            elif "reseed_seq" not in df.columns:
                df = df.withColumn("reseed_seq", F.lit(None).cast("int"))
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/generation={generation}")

    def add(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> int:
        """A new generation: the published one with nodes and edges put over those of the same key."""
        old, g = self.published(), self.begin_generation()
        now = [self.read(name) if old else None for name in ("nodes", "edges")]
        stamp = lambda df: df.withColumn("reseed_seq", F.lit(self.reseed_seq).cast("int"))
        whole = [upsert(o, stamp(n), key) if n is not None else o for o, n, key in zip(now, (nodes, edges), (NODE_KEY, EDGE_KEY))]
        if None in whole:
            raise ValueError("a first generation needs nodes and edges")
        seq, self.reseed_seq = self.reseed_seq, None  # old rows keep their number
        self.write(g, *whole)
        self.reseed_seq = seq
        return g

    def read(self, name: str, generation: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/generation={self.published() if generation is None else generation}")

    def flip(self, generation: int) -> None:
        """Journal the change against the published generation, publish (one small file is the switch), then drop older generations."""
        old = self.published()
        for name, key in (("nodes", NODE_KEY), ("edges", EDGE_KEY)):
            new = snapshot(self.read(name, generation), key)
            before = snapshot(self.read(name, old), key) if old else new.limit(0)
            diff(before, new).select("*", F.lit(name).alias("what"), F.lit(generation).alias("generation")).write.mode("append").parquet(f"{self.path}/journal")
        self.spark.createDataFrame([(generation,)], "generation int").coalesce(1).write.mode("append").parquet(f"{self.path}/published")
        for name in ("nodes", "edges"):
            for n in self._numbers(name):
                if n < generation:
                    fs, place = self._fs(f"{name}/generation={n}")
                    fs.delete(place, True)

    def history(self, limit: int = 100, entity: str | None = None) -> DataFrame:
        """The journal, newest first; of one entity if named."""
        rows = self._read("journal", "entity string, change string, what string, generation int")
        rows = rows.where(F.col("entity") == entity) if entity is not None else rows
        return rows.orderBy(F.desc("generation"), "what", "entity").limit(limit)

    def purge_node(self, node: str) -> None:
        """A new generation without the node and its edges."""
        g = self.begin_generation()
        edges = self.read("edges").where((F.col("src") != node) & (F.col("dst") != node))
        self.write(g, self.read("nodes").where(F.col("id") != node), edges)
        self.flip(g)

    def counts(self) -> DataFrame:
        """``what, value, n``: nodes by primitive and edges by relation."""
        return counts(self.read("nodes"), self.read("edges"))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.groupBy(F.col("primitive").alias("value")).agg(F.count("*").alias("n")).select(F.lit("primitive").alias("what"), "value", "n")
    return a.union(edges.groupBy(F.col("relation").alias("value")).agg(F.count("*").alias("n")).select(F.lit("relation").alias("what"), "value", "n"))
