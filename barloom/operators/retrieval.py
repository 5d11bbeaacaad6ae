"""Vector retrieval: dense top-k, latent semantic index, fused rankings, chunks for a dense index."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.graph import FUNCTION_WORDS, fuse
from barloom.plans.storage import drop_table, write_table

#: Weights of the text bands, words of a chunk, chunks of a node.
BAND_WEIGHTS = (3, 2, 2, 1, 1)
CHUNK_WORDS, MAX_CHUNKS = 180, 8
#: Terms of several items whose products are held at once, and terms of a row of sums; slices don't cross blocks.
BLOCK_TERMS, SLICE_TERMS = 32_768, 256
#: A column that more than one of so many rows has is dense in a product.
DENSE_SHARE = 50


def dense_similar(vectors: DataFrame, question: list[float], k: int = 10, *, id_col: str = "id", vec_col: str = "vec", subset: DataFrame | None = None) -> DataFrame:
    """``id, score``: per id the greatest cosine of its rows to the question, k best, ties by id.

    Null vectors and ids, other lengths, NaN and all-zero vectors are left out.  The question is a
    literal: one pass with map-side maxima and a bounded top-k.
    """
    q = np.asarray(question, float)
    q = q / np.linalg.norm(q)
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vec_col) == len(q))).select(F.col(id_col).alias("id"), v.alias("v"))
    if subset is not None:
        rows = rows.join(subset.select("id").distinct(), "id", "left_semi")
    lit = F.array(*[F.lit(float(x)) for x in q])
    dot = F.aggregate(F.zip_with("v", lit, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    scored = rows.select("id", dot.alias("dot"), norm.alias("norm")).where((F.col("norm") > 0) & ~F.isnan("norm") & F.col("dot").isNotNull())
    return scored.groupBy("id").agg(F.max(F.col("dot") / F.col("norm")).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def ranking(df: DataFrame, name: str, k: int = 60) -> DataFrame:
    """Scores as rows (ranking, id, rank) for fusion; k rows are ranked."""
    top = df.orderBy(F.desc("score"), "id").limit(k)
    return top.select(F.lit(name).alias("ranking"), "id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))


def fuse_rankings(*rankings: DataFrame) -> DataFrame:
    whole = rankings[0]
    for r in rankings[1:]:
        whole = whole.unionByName(r)
    return fuse(whole)


def chunks_of(haystacks: DataFrame, summaries: DataFrame, max_chunks: int | None = MAX_CHUNKS) -> DataFrame:
    """``id, row_no, text``: a node's name and summary, then windows of its details led by the name, eight rows at most by default (None: all)."""
    rows = haystacks.join(summaries.selectExpr("id", "summary as own_summary"), "id")
    words = F.filter(F.split(F.concat_ws(" ", "t2", "t3", "t4"), r"\s+"), lambda w: w != "")
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words), F.lit(CHUNK_WORDS))).otherwise(F.array().cast("array<int>"))
    detail = F.transform(starts, lambda s: F.concat(F.col("name"), F.lit(". "), F.array_join(F.slice(words, s, F.lit(CHUNK_WORDS)), " ")))
    head = F.array(F.trim(F.concat(F.col("name"), F.lit(". "), F.coalesce("own_summary", F.lit("")))))
    chunks = F.concat(head, detail)
    return rows.select("id", F.posexplode(chunks if max_chunks is None else F.slice(chunks, 1, max_chunks)).alias("row_no", "text"))


def weighted_documents(haystacks: DataFrame) -> DataFrame:
    """``id, text``: the bands of each node, every one repeated by its weight."""
    bands = [F.array_repeat(F.col(f"t{i}"), w) for i, w in enumerate(BAND_WEIGHTS)]
    return haystacks.select("id", F.array_join(F.concat(*bands), " ").alias("text"))


def _numbers(column: pa.BinaryArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that a binary column holds, in one array, and how many each row has."""
    size = np.dtype(dtype).itemsize
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype, (ends[-1] - ends[0]) // size, ends[0]) if data is not None and ends[-1] > ends[0] else np.zeros(0, dtype)
    return flat, np.diff(ends) // size


def _binary(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column of numbers, so many in each row."""
    flat = np.ascontiguousarray(flat)
    ends = np.concatenate([[0], np.cumsum(lengths)]) * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])


def _signs(keys: np.ndarray, width: int) -> np.ndarray:
    """``width`` random signs for each 64-bit key, always the same ones."""
    x = keys.astype(np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95) + np.arange(1, width // 64 + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return np.unpackbits(x.view(np.uint8), axis=1)[:, :width] * 2.0 - 1.0


class _Sparse:
    """Rows of some items as a matrix: columns that many rows have as a dense part, the rest entry by entry."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, x: np.ndarray, n: int):
        self.n = n
        seen, at, count = np.unique(cols, return_inverse=True, return_counts=True)
        common = count * DENSE_SHARE > n
        self.cols, place = seen[common], np.cumsum(common) - 1
        mine = common[at]
        self.dense = np.zeros((n, len(self.cols)))
        self.dense[rows[mine], place[at[mine]]] = x[mine]
        self.rest = rows[~mine], cols[~mine], x[~mine]

    @staticmethod
    def _add(out: np.ndarray, to: np.ndarray, of: np.ndarray, x: np.ndarray, values: np.ndarray) -> None:
        """out[to] += x * values[of] for entries in the order of ``to``, some at a time."""
        for s in range(0, len(to), 20_000):
            t = to[s : s + 20_000]
            first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            out[t[first]] += np.add.reduceat(values[of[s : s + 20_000]] * x[s : s + 20_000, None], first)

    def times(self, z: np.ndarray) -> np.ndarray:
        out = self.dense @ z[self.cols]
        rows, cols, x = self.rest
        self._add(out, rows, cols, x, z)
        return out

    def add_transposed(self, y: np.ndarray, total: np.ndarray) -> None:
        """total += A' y"""
        total[self.cols] += self.dense.T @ y
        rows, cols, x = self.rest
        order = np.argsort(cols, kind="stable")
        self._add(total, cols[order], rows[order], x[order], y)


_STATE = "id string, key long, own double, norm double, i binary, x binary, y binary, new binary"


def _items(batches, width: int, start: int, size: int):
    """Items a few at a time: their batch, their matrix over the terms of one block, own, y."""
    for whole in batches:
        for s in range(0, whole.num_rows, 2048):
            b = whole.slice(s, 2048)
            i, lengths = _numbers(b["i"], np.int32)
            rows = np.repeat(np.arange(b.num_rows), lengths)
            x = _numbers(b["x"], np.float64)[0] / np.repeat(b["norm"].to_numpy(), lengths)
            mine = (i >= start) & (i < start + size)
            a = _Sparse(rows[mine], i[mine] - start, x[mine], b.num_rows)
            yield b, a, b["own"].to_numpy(), _numbers(b["y"], np.float32)[0].reshape(b.num_rows, width).astype(float)


def _sums(state: DataFrame, width: int, start: int, size: int) -> DataFrame:
    """``part, at, sum``: A' y over the terms of one block in slices of terms; part -1 holds y' y above y' own y."""

    def run(batches):
        total, own_part = np.zeros((size, width)), np.zeros((2 * width, width))
        for _, a, own, y in _items(batches, width, start, size):
            a.add_transposed(y, total)
            own_part[:width] += y.T @ y
            own_part[width:] += y.T @ (y * own[:, None])
        slices = [(-1, own_part)] + [((start + s) // SLICE_TERMS, total[s : s + SLICE_TERMS]) for s in range(0, size, SLICE_TERMS)]
        for part, rows in slices:
            at = np.flatnonzero(rows.any(axis=1)).astype(np.int32)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([rows[at].tobytes()], pa.binary())], ["part", "at", "sum"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((max(SLICE_TERMS, 2 * width), width))
        for at, rows in zip(pdf["at"], pdf["sum"]):
            total[np.frombuffer(at, np.int32)] += np.frombuffer(rows).reshape(-1, width)
        at = np.flatnonzero(total.any(axis=1)).astype(np.int32)
        return pd.DataFrame({"part": pdf["part"].iloc[:1].to_numpy(), "at": [at.tobytes()], "sum": [total[at].tobytes()]})

    few = state.select("own", "norm", "i", "x", "y").coalesce(state.sparkSession.sparkContext.defaultParallelism)
    schema = "part int, at binary, sum binary"
    return few.mapInArrow(run, schema).groupBy("part").applyInPandas(add, schema)


def _read_sums(sums: DataFrame, width: int, start: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A' y of one block (at most BLOCK_TERMS rows), y' y, y' own y."""
    z, own_part = np.zeros((size, width)), np.zeros((2 * width, width))
    for r in sums.collect():
        at, rows = np.frombuffer(r["at"], np.int32), np.frombuffer(r["sum"]).reshape(-1, width)
        if r["part"] < 0:
            own_part[at] = rows
        else:
            z[at + r["part"] * SLICE_TERMS - start] = rows
    return z, own_part[:width], own_part[width:]


def _whitening(gram: np.ndarray) -> np.ndarray:
    """t with t' gram t = 1, of the directions that are there; the greatest first."""
    values, vecs = np.linalg.eigh((gram + gram.T) / 2)
    kept = [j for j in np.argsort(-values) if values[j] > 1e-12 * values.max()]
    return vecs[:, kept] / np.sqrt(values[kept])


def _step(state: DataFrame, z: np.ndarray, t: np.ndarray, start: int, last: bool) -> DataFrame:
    """Write the items with what one block adds to A (A' y t): the first block brings own y t, after the last one the sum is y."""
    spark = state.sparkSession
    shared = spark.sparkContext.broadcast((z, t))

    def run(batches):
        z, t = shared.value
        for b, a, own, y in _items(batches, len(t), start, len(z)):
            new = a.times(z) + (own[:, None] * (y @ t) if start == 0 else _numbers(b["new"], np.float32)[0].reshape(y.shape[0], t.shape[1]))
            new = _binary(new.astype(np.float32).ravel(), np.full(b.num_rows, t.shape[1]))
            none = _binary(np.zeros(0, np.float32), np.zeros(b.num_rows, int))
            cols = [b[c] for c in ("id", "key", "own", "norm", "i", "x")] + ([new, none] if last else [b["y"], new])
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _STATE.split(", ")])

    out = write_table(state.mapInArrow(run, _STATE), "lsa")
    shared.destroy()
    return out


@dataclass
class SemanticIndex:
    """Latent semantic index: tables of terms and items, none of which is held in the driver.

    ``docs`` has the terms of each item, ``counts`` the items of each term, ``numbered`` the numbers of the terms of several items,
    ``state`` the items before the last product, ``sums`` that product by slices of terms, ``found`` the projected items.
    """

    docs: DataFrame
    counts: DataFrame
    numbered: DataFrame
    n: int
    state: DataFrame
    sums: list[DataFrame]
    rotation: np.ndarray
    found: DataFrame

    @property
    def vectors(self) -> DataFrame:
        """``id, vec``: the items' vectors, of unit length unless zero."""
        width = self.rotation.shape[1]

        def run(batches):
            for b in batches:
                v = _numbers(b["y"], np.float32)[0].reshape(b.num_rows, width).astype(float)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                v = v / np.where(size > 0, size, 1)
                ends = pa.array(np.arange(b.num_rows + 1) * width, pa.int32())
                yield pa.RecordBatch.from_arrays([b["id"], pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], ["id", "vec"])

        return self.found.select("id", "y").mapInArrow(run, "id string, vec array<double>")

    @cached_property
    def terms(self) -> dict[str, int]:
        """All terms by their place; collects the vocabulary, so for small ones."""
        return {r["term"]: j for j, r in enumerate(self.counts.orderBy("term").toLocalIterator())}

    @cached_property
    def components(self) -> np.ndarray:
        """Width x terms, in the order of ``terms``; for small vocabularies."""
        known = self._known(list(self.terms))
        return np.stack([known[t][1] for t in self.terms], axis=1)

    @cached_property
    def digest(self) -> str:
        """Of the set of terms, whatever their order."""
        h = F.xxhash64("term")
        got = self.counts.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
        return hashlib.sha256(repr(tuple(map(str, got))).encode()).hexdigest()

    def _known(self, terms: list[str]) -> dict[str, tuple[float, np.ndarray]]:
        """idf and component column of those terms that occur: a column is A' y over the items that hold the term, rotated."""
        spark = self.docs.sparkSession
        asked = lambda ts: F.broadcast(spark.createDataFrame([(t,) for t in ts], "term string"))
        width = len(self.rotation)
        idf = lambda df: float(np.log((1 + self.n) / (1 + df)) + 1)
        out: dict = {}
        several = {r["i"]: r for r in self.numbered.join(asked(terms), "term").collect()} if terms else {}
        parts = spark.createDataFrame([(p,) for p in sorted({i // SLICE_TERMS for i in several})], "part int")
        for sums in self.sums if several else ():
            for r in sums.join(F.broadcast(parts), "part").toLocalIterator():
                for j, row in zip(np.frombuffer(r["at"], np.int32), np.frombuffer(r["sum"]).reshape(-1, width)):
                    if (hit := several.get(int(j) + r["part"] * SLICE_TERMS)) is not None:
                        out[hit["term"]] = idf(hit["df"]), row @ self.rotation
        for r in several.values():
            out.setdefault(r["term"], (idf(r["df"]), np.zeros(self.rotation.shape[1])))
        rest = [t for t in terms if t not in out]
        single = [r["term"] for r in self.counts.join(asked(rest), "term").collect()] if rest else []
        if single:
            held = self.docs.select("id", F.explode(F.arrays_zip("t", "tf")).alias("e")).select("id", F.col("e.t").alias("term"), F.col("e.tf").alias("tf")).join(asked(single), "term")
            for r in self.state.select("id", "norm", "y").join(F.broadcast(held), "id").toLocalIterator():
                y = np.frombuffer(r["y"], np.float32).astype(float)
                out[r["term"]] = idf(1), (1 + np.log(r["tf"])) * idf(1) / r["norm"] * (y @ self.rotation)
        return out

    def embed(self, text: str) -> np.ndarray | None:
        """(1 + ln tf) idf of known terms, projected, unit length; None without a known term."""
        seen = Counter(re.findall(r"[a-z0-9]{2,}", text.lower()))
        known = self._known(sorted(seen))
        if not known:
            return None
        x = np.array([(1 + np.log(seen[t])) * idf for t, (idf, _) in known.items()])
        y = (x / np.linalg.norm(x)) @ np.stack([v for _, v in known.values()])
        n = np.linalg.norm(y)
        return y / n if n else None

    def matches(self, digest: str) -> bool:
        return digest == self.digest

    def similar(self, question: str, k: int = 10, subset: DataFrame | None = None) -> DataFrame:
        """``id, score``: the k items of the greatest cosine to the question, ties by id; items whose vector is zero are left out."""
        q = self.embed(question)
        if q is None:
            return self.found.select("id", F.lit(0.0).alias("score")).limit(0)

        def run(batches):
            for b in batches:
                v = _numbers(b["y"], np.float32)[0].reshape(b.num_rows, len(q)).astype(float)
                size = np.linalg.norm(v, axis=1)
                at = np.flatnonzero(size > 0)
                yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(at)), pa.array((v[at] @ q) / size[at])], ["id", "score"])

        scored = self.found.select("id", "y").mapInArrow(run, "id string, score double")
        if subset is not None:
            scored = scored.join(subset.select("id").distinct(), "id", "left_semi")
        return scored.orderBy(F.desc("score"), "id").limit(k)


def _count_terms(batches):
    for b in batches:
        ids, terms, tfs, ends = [], [], [], [0]
        for i, text in zip(b["id"].to_pylist(), b["text"].to_pylist()):
            seen = Counter(w for w in re.findall(r"[a-z0-9]{2,}", text) if w not in FUNCTION_WORDS)
            if seen:
                ids.append(i)
                terms += seen
                tfs += seen.values()
                ends.append(len(terms))
        ends = pa.array(ends, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.string())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))], ["id", "t", "tf"])


def _number(counts: DataFrame) -> tuple[DataFrame, int]:
    """``term, df, i``: terms of several items, the most frequent first, numbered from 0 in their order; and their number."""
    order = counts.where("df > 1").orderBy(F.desc("df"), "term").select("term", "df", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    ranked = write_table(order, "ranked")
    shifts, size = [], 0
    for r in ranked.groupBy("p").agg(F.count("*").alias("n"), F.min("m").alias("m")).orderBy("p").collect():
        shifts.append((r["p"], size - r["m"]))
        size += r["n"]
    shift = F.broadcast(counts.sparkSession.createDataFrame(shifts, "p int, shift long"))
    return ranked.join(shift, "p").select("term", "df", (F.col("m") + F.col("shift")).cast("int").alias("i")), size


def _first_state(docs: DataFrame, numbered: DataFrame, size: int, n: int, width: int, seed: int) -> DataFrame:
    """The items with their entries, and y = A times random signs.

    The terms of the first block are numbered by a broadcast of at most BLOCK_TERMS, those of later blocks by a join of their few entries.
    """
    spark = docs.sparkSession
    rows = docs.select("id", F.xxhash64("id", F.lit(seed)).alias("key"), "t", "tf")
    hot = [r["term"] for r in numbered.where(F.col("i") < BLOCK_TERMS).orderBy("i").collect()]
    if size > BLOCK_TERMS:
        entries = docs.select("id", F.explode(F.arrays_zip("t", "tf")).alias("e")).select("id", F.col("e.t").alias("term"), F.col("e.tf").alias("tf"))
        entries = entries.join(F.broadcast(numbered.where(F.col("i") < BLOCK_TERMS).select("term")), "term", "left_anti")
        later = entries.join(numbered.where(F.col("i") >= BLOCK_TERMS), "term").groupBy("id").agg(F.collect_list(F.struct("i", "tf", "df")).alias("e"))
        rows = rows.join(later, "id", "left").select("id", "key", "t", "tf", *[F.coalesce(F.col(f"e.{c}").cast("array<long>"), F.array().cast("array<long>")).alias(f"r{c}") for c in ("i", "tf", "df")])
    else:
        rows = rows.select("*", *[F.array().cast("array<long>").alias(f"r{c}") for c in ("i", "tf", "df")])
    df = [r["df"] for r in numbered.where(F.col("i") < BLOCK_TERMS).orderBy("i").collect()]
    shared = spark.sparkContext.broadcast((hot, np.log((1 + n) / (1 + np.array(df, float))) + 1))

    def flat(column):
        return column.flatten(), np.diff(column.offsets.to_numpy())

    def run(batches):
        import pyarrow.compute as pc

        hot, idf = shared.value
        one = np.log((1 + n) / 2) + 1
        for whole in batches:
            for s in range(0, whole.num_rows, 2048):
                b = whole.slice(s, 2048)
                count = b.num_rows
                terms, lengths = flat(b["t"])
                i = pc.fill_null(pc.index_in(terms, value_set=pa.array(hot, terms.type)), -1).to_numpy().astype(np.int64)
                rows, u = np.repeat(np.arange(count), lengths), 1 + np.log(flat(b["tf"])[0].to_numpy())
                (ri, rlengths), rtf, rdf = flat(b["ri"]), flat(b["rtf"])[0].to_numpy(), flat(b["rdf"])[0].to_numpy()
                ri, rrows, ru = ri.to_numpy(), np.repeat(np.arange(count), rlengths), 1 + np.log(rtf)
                # what is neither in the first block nor in a later one occurs in this item only
                left = i < 0
                own = (np.bincount(rows[left], minlength=count) - np.bincount(rrows, minlength=count) > 0) * np.maximum(np.bincount(rows[left], u[left] ** 2, count) - np.bincount(rrows, ru**2, count), 0) * one**2
                x = np.r_[u[~left] * idf[i[~left]], ru * (np.log((1 + n) / (1 + rdf)) + 1)]
                i, rows = np.r_[i[~left], ri].astype(np.int32), np.r_[rows[~left], rrows]
                order = np.argsort(rows, kind="stable")
                i, rows, x = i[order], rows[order], x[order]
                norm = np.sqrt(np.bincount(rows, x**2, count) + own)
                own = own / norm**2
                seen, at = np.unique(i, return_inverse=True)
                y = _Sparse(rows, at, x / norm[rows], count).times(_signs(seen.astype(np.int64) + ((seed + 1) << 40), width))
                y += np.sqrt(own)[:, None] * _signs(b["key"].to_numpy(), width)
                n_terms, none = np.bincount(rows, minlength=count), np.zeros(count, int)
                cols = [b["id"], b["key"], pa.array(own), pa.array(norm), _binary(i, n_terms), _binary(x, n_terms), _binary(y.astype(np.float32).ravel(), np.full(count, width)), _binary(np.zeros(0, np.float32), none)]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _STATE.split(", ")])

    out = write_table(rows.mapInArrow(run, _STATE), "lsa")
    shared.destroy()
    return out


def build_semantic_index(texts: DataFrame, width: int = 64, rounds: int = 4, seed: int = 3) -> SemanticIndex:
    """TF-IDF (sublinear, idf = ln((1 + n) / (1 + df)) + 1, unit length) reduced by a randomised SVD.

    ``texts`` has ``id, text``; function words don't count.  The SVD iterates y = A A' y over the items, whose rows carry y.
    Terms of one item only (names, numbers) stand in no table: together they are one column of the item's own, whose square is
    added on the diagonal of A A', which changes no product.  The other terms are taken in blocks of BLOCK_TERMS, so what the
    driver and a task hold of A' y has a fixed size for any vocabulary.
    The sign of a component is arbitrary.  Items without a term have no vector.
    """
    known = texts.where("id is not null and text is not null").groupBy("id").agg(F.lower(F.concat_ws(" ", F.collect_list("text"))).alias("text"))
    docs = write_table(known.mapInArrow(_count_terms, "id string, t array<string>, tf array<int>"), "docs")
    counts = write_table(docs.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "counts")
    n, terms = docs.count(), counts.count()
    numbered, size = _number(counts)
    numbered = write_table(numbered, "terms")
    k = max(1, min(width, terms, n))
    held = k + 10
    state = _first_state(docs, numbered, size, n, held, seed)
    blocks = [(a, min(BLOCK_TERMS, size - a)) for a in range(0, size, BLOCK_TERMS)] or [(0, 1)]

    def after(old: DataFrame, new: DataFrame) -> DataFrame:
        drop_table(old)
        return new

    for _ in range(rounds):
        for a, many in blocks:
            z, gram, _own = _read_sums(_sums(state, held, a, many), held, a, many)
            if a == 0:
                t = _whitening(gram)
            state = after(state, _step(state, z @ t, t, a, a == blocks[-1][0]))
        held = t.shape[1]
    sums, small = [], np.zeros((held, held))
    for a, many in blocks:
        sums.append(write_table(_sums(state, held, a, many), "sums"))
        z, gram, own = _read_sums(sums[-1], held, a, many)
        if a == 0:
            t = _whitening(gram)
            small = t.T @ own @ t
        small = small + (z @ t).T @ (z @ t)
    t = (t @ _whitening(small))[:, :k]
    found = state
    for (a, many), s in zip(blocks, sums):
        z = _read_sums(s, held, a, many)[0]
        new = _step(found, z @ t, t, a, a == blocks[-1][0])
        found = new if found is state else after(found, new)
    return SemanticIndex(docs, counts, numbered, n, state, sums, t, found)


def encoder_available() -> bool:
    """Whether a sentence encoder can run here: the runtime is there and a model is configured."""
    try:
        import onnxruntime  # noqa: F401
    except ImportError:
        return False
    import os

    return bool(os.environ.get("BARLOOM_ENCODER"))


def encode_texts(texts: DataFrame, model_path: str, tokenizer_path: str, most_tokens: int = 256) -> DataFrame:
    """``id, vec``: unit vectors of ``id, text`` by a supplied ONNX sentence encoder (masked mean of the token states).

    The model is loaded once a worker; null texts have a null vector.
    """
    import os

    for path in (model_path, tokenizer_path):
        if not os.path.exists(path):
            raise FileNotFoundError(path)

    def run(batches):
        import onnxruntime
        from tokenizers import Tokenizer

        model = onnxruntime.InferenceSession(model_path)
        tok = Tokenizer.from_file(tokenizer_path)
        tok.enable_truncation(most_tokens)
        tok.enable_padding()
        names = {i.name for i in model.get_inputs()}
        for b in batches:
            held = b.column(1).to_pylist()
            at = [i for i, t in enumerate(held) if t is not None]
            out: list = [None] * len(held)
            for k in range(0, len(at), 32):
                part = at[k : k + 32]
                enc = tok.encode_batch([held[i] for i in part])
                ids, mask = (np.array([getattr(e, a) for e in enc], np.int64) for a in ("ids", "attention_mask"))
                feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
                states = model.run(None, {n: v for n, v in feed.items() if n in names})[0]
                mean = (states * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)
                mean = mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)
                for i, v in zip(part, mean):
                    out[i] = v.astype(float).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], ["id", "vec"])

    return texts.select("id", "text").mapInArrow(run, "id string, vec array<double>")
