"""Mixing sources to target weights.

Method: multivariate-hypergeometric splitting tree.  Every source's quota is a hash permutation of
its uses, cut into blocks: consecutive ranges of the running sum of tokens, all of the same size but
for the last.  The block counts are split down a binary tree over the output shards, each split
drawn from the multivariate hypergeometric distribution, so that each shard gets an exact, random
number of blocks of each source.  The permutation is random, hence shards take consecutive blocks,
which are disjoint.  Records are shuffled inside their shard only.  The upper tree is one task a
mix, its subtrees are tasks of their own; the driver sees one row a target.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, floor, lgamma, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.bpe import count_tokens
from barloom.plans.storage import write_table

#: Tokens of a block and of an output shard.
BLOCK_TOKENS = 20_000
SHARD_TOKENS = 200_000
#: Expected documents of one permutation bucket; a task sorts one bucket at a time.
BUCKET_DOCS = 5_000


#: Shards of a subtree that one task splits to the end.
SUBTREE = 4_096
_NODES = "mix_id string, sources array<string>, shards long, total long, lo long, hi long, counts array<long>, first array<long>"


@dataclass
class Mix:
    draw: DataFrame
    shares: DataFrame


def hypergeometric(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """Good ones among ``draws`` without replacement, of any size (the generator itself ends at 10**9)."""
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if good and bad else draws if good else 0
    n, least, most = good + bad, max(0, draws - bad), min(good, draws)
    if least == most:
        return least
    mean, mode = draws * good / n, (draws + 1) * (good + 1) // (n + 2)
    weight = lambda k: -lgamma(k + 1) - lgamma(good - k + 1) - lgamma(draws - k + 1) - lgamma(bad - draws + k + 1)
    top, spread = weight(mode), sqrt(mean * bad / n * (n - draws) / (n - 1) + 0.5)
    width = 2 * sqrt(2 / exp(1)) * spread + 3 - 2 * sqrt(3 / exp(1))
    while True:  # ratio of uniforms
        u, v = 1 - rng.random(), rng.random()
        k = floor(mean + 0.5 + width * (v - 0.5) / u)
        if least <= k <= most and 2 * log(u) <= weight(k) - top:
            return k


def split_counts(counts: list[int], draws: int, rng: np.random.Generator) -> list[int]:
    """A multivariate hypergeometric draw of ``draws`` blocks, source by source."""
    out, rest = [], sum(counts)
    for c in counts:
        rest -= c
        out.append(hypergeometric(c, rest, draws, rng))
        draws -= out[-1]
    return out


def descend(node: tuple, stop: int, seed: int) -> Iterator[tuple]:
    """The subtrees of at most ``stop`` shards below a node ``(mix, sources, shards, total, lo, hi, counts, first)``.

    Shards differ by at most one block; a node's split depends on its place alone, so a task run again gives the same.
    """
    todo = [node]
    while todo:
        mix, sources, shards, total, lo, hi, counts, first = todo.pop()
        if hi - lo <= stop:
            yield mix, sources, shards, total, lo, hi, counts, first
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, zlib.crc32(mix.encode()), lo, hi])
        left = split_counts(counts, total * mid // shards - total * lo // shards, rng)
        right = [c - x for c, x in zip(counts, left)]
        todo.append((mix, sources, shards, total, mid, hi, right, [f + x for f, x in zip(first, left)]))
        todo.append((mix, sources, shards, total, lo, mid, left, first))


def _descend(nodes: DataFrame, stop: int, seed: int) -> DataFrame:
    names = [c.split()[0] for c in _NODES.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = ((r.mix_id, list(r.sources), int(r.shards), int(r.total), int(r.lo), int(r.hi), [int(x) for x in r.counts], [int(x) for x in r.first]) for r in pdf.itertuples())
            part: list = []
            for row in (x for r in rows for x in descend(r, stop, seed)):
                part.append(row)
                if len(part) == 10_000:
                    yield pd.DataFrame(part, columns=names)
                    part = []
            yield pd.DataFrame(part, columns=names)

    return nodes.mapInPandas(run, _NODES)


def mix_sources(documents: DataFrame, targets: DataFrame, *, text: str = "text", block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, bucket_docs: int = BUCKET_DOCS, subtree: int = SUBTREE, seed: int = 7) -> Mix:
    """Draw each mix of ``targets`` (mix_id, source, target_weight, max_repeats, budget_tokens).

    ``draw``: ``mix_id, shard, position, doc_id, source, copy_no, n_tokens``, one row per use of a
    document.  ``shares``: per mix and source the target and actual share and sizes.

    A source's quota is its relative weight times the budget, at most ``max_repeats`` uses of each
    of its documents.  It is met by whole passes over the source and, for the rest, by the longest
    prefix of a random order of its documents that doesn't exceed it; a source thus misses its
    quota by less than one document.  What a source can't give is left open, not given to others;
    ``actual_share`` is relative to what the mix holds, ``target_share`` sums to 1.  Null or
    negative weights and repeats count as 0; repeated target rows count once, of several rows for a
    source the largest weight, repeats and budget count.  Documents without tokens (null and empty
    texts) are never drawn; repeated rows of a doc_id count once (the smallest source).  A source
    without documents stays in ``shares`` with 0.
    """
    spark = documents.sparkSession
    aims = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(
        F.greatest(F.coalesce(F.max("target_weight"), F.lit(0.0)), F.lit(0.0)).alias("w"),
        F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("repeats"),
        F.coalesce(F.max("budget_tokens"), F.lit(0)).alias("budget"),
    )
    aims = aims.toPandas().sort_values(["mix_id", "source"]).reset_index(drop=True)  # one row per target: a configuration
    budget = aims.groupby("mix_id")["budget"].transform("max")
    total_w = aims.groupby("mix_id")["w"].transform("sum")
    aims["target_share"] = np.where(total_w > 0, aims["w"] / total_w.where(total_w > 0, 1), 0.0)
    aims["quota"] = np.floor(aims["target_share"] * budget + 1e-9).astype("int64")

    names = aims["source"].unique().tolist()
    named = documents.where(F.col("source").isin(names)) if names else documents.where(F.lit(False))
    sized = count_tokens(named, ["doc_id", "source"], text)
    sized = write_table(sized.where("doc_id is not null and n_tokens > 0").groupBy("doc_id").agg(F.min("source").alias("source"), F.max("n_tokens").alias("n_tokens")), "sized")
    stock = {r.source: (r.docs, r.tokens) for r in sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).collect()}
    aims["docs"] = [stock.get(s, (0, 0))[0] for s in aims["source"]]
    aims["tokens"] = [stock.get(s, (0, 0))[1] for s in aims["source"]]
    have = aims["tokens"].clip(lower=1)
    aims["passes"] = np.where(aims["tokens"] > 0, np.minimum(aims["quota"] // have, aims["repeats"]), 0).astype("int64")
    aims["rest"] = np.where((aims["passes"] < aims["repeats"]) & (aims["tokens"] > 0), aims["quota"] - aims["passes"] * aims["tokens"], 0).astype("int64")
    aims["buckets"] = np.maximum(1, -(-aims["docs"] // bucket_docs)).astype("int64")

    rows = aims.astype({"repeats": "int64", "docs": "int64", "tokens": "int64"})
    plan = F.broadcast(spark.createDataFrame(rows[["mix_id", "source", "passes", "rest", "buckets"]], "mix_id string, source string, passes long, rest long, buckets long"))

    # the rest of each quota: prefix sums over a hash permutation, first by bucket, then inside the one bucket that is cut
    order = F.xxhash64(F.lit(seed), "mix_id", "doc_id")
    pool = sized.join(plan, "source").withColumn("order", order)
    pool = pool.withColumn("bucket", F.pmod(F.shiftrightunsigned("order", 20), F.col("buckets")))
    sums = pool.where("rest > 0").groupBy("mix_id", "source", "bucket").agg(F.sum("n_tokens").alias("held"))
    before = Window.partitionBy("mix_id", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    pool = pool.join(sums, ["mix_id", "source", "bucket"], "left")
    inside = Window.partitionBy("mix_id", "source", "bucket").orderBy("order", "doc_id")
    running = pool.withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    uses = F.col("passes") + F.when(F.col("rest") > 0, (F.col("upto") <= F.col("rest")).cast("long")).otherwise(0)
    used = running.withColumn("uses", F.coalesce(uses, F.col("passes"))).where("uses > 0")
    used = write_table(used.select("mix_id", "source", "doc_id", "n_tokens", "uses"), "used")

    got = used.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("n_tokens"), F.sum("uses").alias("n_uses"), F.count("*").alias("n_docs"), F.max("uses").alias("most_uses"))
    reached = {(r.mix_id, r.source): r for r in got.collect()}  # one row per target
    roots, numbers = [], []
    for mix, part in aims.groupby("mix_id", sort=True):
        held = [reached.get((mix, s)) for s in part["source"]]
        tokens = [r.n_tokens if r else 0 for r in held]
        blocks = [-(-n // block_tokens) for n in tokens]
        shards = max(1, -(-sum(tokens) // shard_tokens))
        roots.append((mix, part["source"].tolist(), shards, sum(blocks), 0, shards, blocks, [0] * len(blocks)))
        numbers += [(mix, s, -(-r.n_uses // bucket_docs)) for s, r in zip(part["source"], held) if r]
    tree = _descend(spark.createDataFrame(roots, _NODES), subtree, seed)
    leaves = _descend(tree.repartition("mix_id", "lo"), 1, seed)
    spans = leaves.select("mix_id", F.col("lo").cast("int").alias("shard"), F.explode(F.arrays_zip("sources", "counts", "first")).alias("x"))
    spans = spans.where("x.counts > 0").select("mix_id", "shard", F.col("x.sources").alias("source"), F.explode(F.sequence(F.col("x.first"), F.col("x.first") + F.col("x.counts") - 1)).alias("block"))

    # the blocks: ranges of the running sum over a second permutation, again by bucket and inside each
    numbers = F.broadcast(spark.createDataFrame(numbers, "mix_id string, source string, buckets long"))  # one row a target
    each = used.join(numbers, ["mix_id", "source"]).withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))))
    each = each.withColumn("spot", F.xxhash64(F.lit(seed + 1), "mix_id", "doc_id", "copy_no")).withColumn("bucket", F.pmod(F.shiftrightunsigned("spot", 16), F.col("buckets")))
    sums = each.groupBy("mix_id", "source", "bucket").agg(F.sum("n_tokens").alias("held")).withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    earlier = Window.partitionBy("mix_id", "source", "bucket").orderBy("spot", "doc_id", "copy_no").rowsBetween(Window.unboundedPreceding, -1)
    each = each.join(sums.drop("held"), ["mix_id", "source", "bucket"])
    start = F.col("before") + F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))
    each = each.withColumn("block", F.floor(start / block_tokens).cast("long"))
    each = each.join(spans, ["mix_id", "source", "block"])
    place = F.row_number().over(Window.partitionBy("mix_id", "shard").orderBy(F.xxhash64("spot", "shard"), "doc_id", "copy_no"))
    draw = each.select("mix_id", "shard", place.alias("position"), "doc_id", "source", "copy_no", "n_tokens")

    all_tokens = {m: sum(r.n_tokens for (k, _), r in reached.items() if k == m) for m in aims["mix_id"].unique()}
    out = []
    for r in aims.itertuples():
        g = reached.get((r.mix_id, r.source))
        n = g.n_tokens if g else 0
        out.append((r.mix_id, r.source, float(r.target_share), float(n / all_tokens[r.mix_id]) if all_tokens[r.mix_id] else 0.0, int(r.quota), int(n), int(g.n_docs) if g else 0, int(g.n_uses) if g else 0, int(g.most_uses) if g else 0, bool(n == 0 and r.quota > 0 or r.quota > r.repeats * r.tokens)))
    shares = spark.createDataFrame(out, "mix_id string, source string, target_share double, actual_share double, quota_tokens long, n_tokens long, n_docs long, n_uses long, most_uses long, short boolean")
    return Mix(draw, shares)
