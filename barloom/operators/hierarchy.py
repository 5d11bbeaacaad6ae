"""Parent-child links to full hierarchies.

Method: contract partition-local parent chains to fragment exits, solve the smaller
quotient forest recursively, then expand.  Fragments keep chains together: a hash makes
every fourth node a ruler, each node looks for a ruler on its next four links, and the
nodes below one ruler share a fragment (those of a hot ruler are spread).  Inside a
fragment every node follows its parents by pointer doubling until it meets a root, a
circle, or an *exit*: the first ancestor that lies in another fragment.  Only nodes that
are somebody's exit go on to the next level, where they are laid out anew; a level that
shrinks too little is thinned by splicing out an independent set of inner nodes.  The
last level fits one fragment and has no exits.  On the way back each level looks its
exits up in the solution of the next.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.plans.skew import spread_lookup
from barloom.plans.storage import write_table

#: Expected rows of a fragment (a task holds one at a time), and the fewest fragments of the first level.
ROWS_PER_FRAGMENT = 20_000
LEAST_FRAGMENTS = 8
#: One node in so many is a ruler, sought by so many doublings (2 ** DOUBLINGS links).
RULERS, DOUBLINGS = 4, 2
#: A level that keeps more than this share of its rows is followed by splicing.
THIN_ABOVE = 0.7

_STATE = "tree string, node string, parent string, hops long, low string, root string, root_hops long, seg array<string>"


def normal_relation(relation: Column) -> Column:
    """Relation names in one spelling: lower case, runs of other characters as one dash, no outer ones."""
    return F.regexp_replace(F.regexp_replace(F.lower(relation), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def parent_links(edges: DataFrame, nodes: DataFrame | None, relations: list[str]) -> DataFrame:
    """(tree, child, parent) of the named relations; links with a null or unknown end are dropped, repeats count once."""
    links = (
        edges.select(normal_relation(F.col("relation")).alias("tree"), F.col("src").alias("child"), F.col("dst").alias("parent"))
        .where(F.col("tree").isin(relations) & F.col("child").isNotNull() & F.col("parent").isNotNull())
        .distinct()
    )
    if nodes is None:
        return links
    known = nodes.select("id").dropna().distinct()
    links = links.join(known.withColumnRenamed("id", "child"), "child", "left_semi")
    return spread_lookup(links, known.withColumnRenamed("id", "parent"), ["parent"], F.col("child"), "left_semi")


def _follow(pdf: pd.DataFrame, with_paths: bool) -> pd.DataFrame:
    """Resolve one fragment: per node its root or circle if known here, else its exit."""
    n = len(pdf)
    # (tree, node) pairs get codes; a parent that is no node of this fragment gets -1
    trees = pdf["tree"].astype("category").cat.codes.to_numpy().astype(str)
    keys = np.char.add(np.char.add(trees, "\x00"), pdf["node"].to_numpy().astype(str)) if n else np.array([], str)
    has_parent = pdf["parent"].notna().to_numpy()
    parents = np.char.add(np.char.add(trees, "\x00"), pdf["parent"].fillna("").to_numpy().astype(str)) if n else keys
    up = pd.Index(keys).get_indexer(parents)
    up[~has_parent] = -1
    end = up < 0
    here = np.arange(n)
    jump = np.where(end, here, up)
    dist = np.where(end, 0, pdf["hops"].to_numpy(np.int64))
    names, low = np.unique(pdf["low"].to_numpy().astype(str), return_inverse=True) if n else (np.array([], str), np.array([], int))
    own_low, none = low.copy(), len(names)
    low = np.where(end, none, low)
    for _ in range(max(1, int(n).bit_length()) + 1):  # 2**rounds steps exceed any simple path
        dist = dist + dist[jump]
        low = np.minimum(low, low[jump])
        jump = jump[jump]
    on_circle = ~end[jump]
    exits = ~on_circle & has_parent[jump]
    root = pdf["root"].to_numpy(object)[jump]
    root_hops = pdf["root_hops"].fillna(0).to_numpy(np.int64)[jump]
    total = np.where(root_hops < 0, -1, dist + root_hops)
    # an entry of the circle has seen all of it after so many rounds
    root[on_circle] = names[low[jump[on_circle]]] if on_circle.any() else None
    total[on_circle] = -1
    out = pd.DataFrame({"tree": pdf["tree"], "node": pdf["node"]})
    out["target"] = np.where(exits, pdf["parent"].to_numpy(object)[jump], None)
    out["hops"] = np.where(exits, dist + pdf["hops"].to_numpy(np.int64)[jump], 0)
    both = np.minimum(low, own_low[jump])
    out["low"] = np.where(exits, np.append(names, "")[both], None) if n else None
    root[exits] = None
    out["root"] = root
    out["root_hops"] = pd.array(np.where(exits, 0, total), dtype="Int64")
    out.loc[exits, "root_hops"] = pd.NA
    if with_paths:
        segs = pdf["seg"].to_numpy(object)
        made: dict[int, list] = {}
        for i in range(n):
            if on_circle[i]:
                continue
            walk, j = [], i
            while j not in made:
                walk.append(j)
                if end[j]:
                    break
                j = up[j]
            tail: list = [] if walk and end[walk[-1]] and walk[-1] not in made else made[j]
            for w in reversed(walk):
                tail = [*(segs[w] if segs[w] is not None else ()), *tail]
                made[w] = tail
        out["seg"] = [made.get(i) if not on_circle[i] else None for i in range(n)]
    else:
        out["seg"] = None
    return out


def _fragments(level: DataFrame, fragments: int, seed: int, rows_per_fragment: int) -> DataFrame:
    """``level`` with the fragment of each row; rows without a parent or at a ruler begin one."""
    ruler = F.pmod(F.xxhash64("tree", "node", F.lit(seed)), F.lit(RULERS)) == 0
    to = level.select("tree", "node", F.when(F.col("parent").isNull() | ruler, F.col("node")).otherwise(F.col("parent")).alias("to"))
    for _ in range(DOUBLINGS):
        onward = to.select("tree", F.col("node").alias("to"), F.col("to").alias("next"))
        to = write_table(spread_lookup(to, onward, ["tree", "to"], F.col("node"), "left").select("tree", "node", F.coalesce("next", "to").alias("to")), "rulers")
    most = max(1, rows_per_fragment // 4)
    hot = to.groupBy("tree", "to").agg(F.count("*").alias("n")).where(F.col("n") > most).select("tree", "to", F.ceil(F.col("n") / most).alias("parts"))
    to = spread_lookup(to, hot, ["tree", "to"], F.col("node"), "left")
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    frag = F.pmod(F.xxhash64("tree", "to", part, F.lit(seed)), F.lit(fragments)).cast("int")
    return level.join(to.select("tree", "node", frag.alias("frag")), ["tree", "node"])


def _contract(level: DataFrame, fragments: int, seed: int, rows_per_fragment: int, with_paths: bool) -> DataFrame:
    schema = "tree string, node string, target string, hops long, low string, root string, root_hops long, seg array<string>, frag int"

    def fragment(key, pdf):
        return _follow(pdf, with_paths).assign(frag=key[0])

    laid = _fragments(level, fragments, seed, rows_per_fragment) if fragments > 1 else level.withColumn("frag", F.lit(0))
    return laid.repartition(fragments, "frag").groupBy("frag").applyInPandas(fragment, schema)


def _expand(waiting: DataFrame, solved: DataFrame) -> DataFrame:
    """Give rows with a target the root of that target; a hot target is asked for once a fragment."""
    answer = solved.select("tree", F.col("node").alias("target"), F.col("root").alias("a_root"), F.col("root_hops").alias("a_hops"), F.col("seg").alias("a_seg"))
    asked = waiting.select("frag", "tree", "target").distinct().join(answer, ["tree", "target"])
    return waiting.select("frag", "tree", "node", "target", "hops", "seg").join(asked, ["frag", "tree", "target"]).select(
        "tree", "node", F.col("a_root").alias("root"),
        F.when(F.col("a_hops") < 0, F.lit(-1)).otherwise(F.col("hops") + F.col("a_hops")).cast("long").alias("root_hops"),
        F.when(F.col("a_hops") >= 0, F.concat("seg", "a_seg")).alias("seg"),
    )


def hierarchy(links: DataFrame, *, with_paths: bool = True, rows_per_fragment: int = ROWS_PER_FRAGMENT, least_fragments: int = LEAST_FRAGMENTS) -> DataFrame:
    """Resolve links ``(tree, child, parent)`` to one row per node of each tree.

    Result: ``tree, node, parent, root, depth, path``.  ``depth`` is the number of links to the
    root (0 for the root); ``path`` runs from the root to the node and is null without
    ``with_paths``.  A node on a circle or under one has the smallest id of the circle as
    ``root``, depth -1 and a null path; a self link is a circle.  Links with a null are
    ignored, repeated links count once, and of several parents the smallest id counts.
    Other columns of ``links`` are ignored.  No links give no rows.
    """
    links = links.select("tree", "child", "parent").dropna()
    ends = links.select("tree", F.col("child").alias("node"), "parent").union(links.select("tree", F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent")))
    vertices = write_table(ends.groupBy("tree", "node").agg(F.min("parent").alias("parent")), "forest")
    is_root = F.col("parent").isNull()
    seg = F.array("node") if with_paths else F.lit(None).cast("array<string>")
    level = vertices.select(
        "tree", "node", "parent", F.lit(1).cast("long").alias("hops"), F.col("node").alias("low"),
        F.when(is_root, F.col("node")).alias("root"), F.when(is_root, F.lit(0).cast("long")).alias("root_hops"), seg.alias("seg"),
    )
    rows = vertices.count()
    waiting: list[DataFrame] = []
    done: list[list[DataFrame]] = []
    seed = 0
    while True:
        fragments = max(1 if seed else least_fragments, -(-rows // rows_per_fragment))
        found = write_table(_contract(level, fragments, seed, rows_per_fragment, with_paths), "contracted")
        done.append([found.where("target is null").select("tree", "node", "root", "root_hops", "seg")])
        open_rows = found.where("target is not null")
        waiting.append(open_rows)
        if fragments == 1:
            break
        wanted = open_rows.select("tree", F.col("target").alias("node")).distinct()
        level = write_table(
            found.join(wanted, ["tree", "node"], "left_semi").select("tree", "node", F.col("target").alias("parent"), "hops", "low", "root", "root_hops", "seg"), "quotient"
        )
        before, rows = rows, level.count()
        seed += 1
        if rows > THIN_ABOVE * before and rows > rows_per_fragment:
            level, spliced = _splice(level, seed, fragments)
            waiting.append(spliced)
            done.append([])
            rows = level.count()
        if rows == 0:
            break
    solved: DataFrame | None = None
    for open_rows, closed in zip(reversed(waiting), reversed(done)):
        parts = [*closed]
        if solved is not None:
            parts.append(_expand(open_rows, solved))
            if not closed:  # a splicing level keeps what the next level solved
                parts.append(solved)
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        solved = write_table(whole, "solved") if len(waiting) > 1 else whole
    path = F.reverse("seg") if with_paths else F.lit(None).cast("array<string>")
    result = solved.select("tree", "node", "root", F.col("root_hops").alias("depth"), F.when(F.col("root_hops") >= 0, path).alias("path"))
    return result.join(vertices, ["tree", "node"]).select("tree", "node", "parent", "root", "depth", "path")


def _splice(level: DataFrame, seed: int, fragments: int) -> tuple[DataFrame, DataFrame]:
    """Take inner nodes out whose coin shows heads while their parent's shows tails; children skip them."""
    heads = lambda c: F.pmod(F.xxhash64("tree", F.col(c), F.lit(-seed)), F.lit(2)) == 0
    out = (F.col("parent").isNotNull()) & heads("node") & ~heads("parent")
    marked = level.withColumn("out", F.coalesce(out, F.lit(False)))
    gone = marked.where("out").select("tree", "node", "parent", "hops", "low", "seg")
    skip = gone.select("tree", F.col("node").alias("parent"), F.col("parent").alias("g_parent"), F.col("hops").alias("g_hops"), F.col("low").alias("g_low"), F.col("seg").alias("g_seg"))
    kept = spread_lookup(marked.where("not out"), skip, ["tree", "parent"], F.col("node"), "left")
    via = F.col("g_parent").isNotNull()
    level = kept.select(
        "tree", "node", F.coalesce("g_parent", "parent").alias("parent"),
        F.when(via, F.col("hops") + F.col("g_hops")).otherwise(F.col("hops")).alias("hops"),
        F.when(via, F.least("low", "g_low")).otherwise(F.col("low")).alias("low"),
        "root", "root_hops", F.when(via, F.concat("seg", "g_seg")).otherwise(F.col("seg")).alias("seg"),
    )
    frag = F.pmod(F.xxhash64("tree", "node"), F.lit(fragments)).cast("int")
    spliced = gone.select("tree", "node", F.col("parent").alias("target"), "hops", "low", F.lit(None).cast("string").alias("root"), F.lit(None).cast("long").alias("root_hops"), "seg", frag.alias("frag"))
    return write_table(level, "spliced"), spliced


def descendants(resolved: DataFrame) -> DataFrame:
    """All (tree, ancestor, node, distance) pairs of :func:`hierarchy` with paths; a row per pair, none for circles."""
    steps = resolved.where("path is not null").select("tree", "node", "depth", F.posexplode("path").alias("pos", "ancestor"))
    return steps.where(F.col("pos") < F.col("depth")).select("tree", "ancestor", "node", (F.col("depth") - F.col("pos")).alias("distance"))
