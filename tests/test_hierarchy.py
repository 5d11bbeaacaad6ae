import random

import pytest

from barloom.operators.hierarchy import descendants, hierarchy, parent_links

SCHEMA = "tree string, child string, parent string"


def brute(links):
    up = {}
    for t, c, p in links:
        if None not in (t, c, p):
            up[t, c] = min(p, up.get((t, c), p))
    nodes = {k for k in up} | {(t, p) for (t, _), p in up.items()}
    out = {}
    for t, n in nodes:
        way, at = [n], n
        while (t, at) in up and up[t, at] not in way:
            at = up[t, at]
            way.append(at)
        if (t, at) in up:
            out[t, n] = (min(way[way.index(up[t, at]):]), -1, None)
        else:
            out[t, n] = (at, len(way) - 1, way[::-1])
    return out


def solve(spark, links, **kw):
    rows = hierarchy(spark.createDataFrame(links, SCHEMA), **kw).collect()
    return {(r.tree, r.node): (r.root, r.depth, r.path) for r in rows}


def sample(seed, n=300):
    r = random.Random(seed)
    links = [("a", f"n{i}", f"n{i + 1}") for i in range(120)]  # a long chain
    links += [("b", f"c{i}", f"c{(i + 1) % 37}") for i in range(37)] + [("b", "self", "self"), ("b", "below", "self")]
    links += [("a", f"m{i}", f"m{r.randrange(i)}" if r.random() < 0.9 else "hub") for i in range(1, n)]
    links += [("b", f"x{i}", f"x{r.randrange(60)}") for i in range(60)]
    return links + links[:40] + [("a", None, "n1"), ("a", "n1", None), (None, "n1", "n2")]


@pytest.mark.parametrize("rows_per_fragment", [40, 10_000])
def test_against_walks(spark, rows_per_fragment):
    links = sample(rows_per_fragment)
    assert solve(spark, links, rows_per_fragment=rows_per_fragment) == brute(links)


def test_several_parents_and_empty(spark):
    assert solve(spark, [("t", "a", "c"), ("t", "a", "b"), ("t", "b", "d")])["t", "a"] == ("d", 2, ["d", "b", "a"])
    assert solve(spark, []) == {}


def test_without_paths_and_descendants(spark):
    links = [("t", "a", "b"), ("t", "b", "c"), ("t", "l", "l")]
    assert solve(spark, links, with_paths=False)["t", "a"] == ("c", 2, None)
    pairs = descendants(hierarchy(spark.createDataFrame(links, SCHEMA)))
    assert {(r.ancestor, r.node, r.distance) for r in pairs.collect()} == {("c", "a", 2), ("c", "b", 1), ("b", "a", 1)}


def test_links_are_cleaned(spark):
    edges = spark.createDataFrame(
        [("a", "b", " Kind_Of", "w", 1), ("a", "b", "kind of", "v", 2), ("a", "zz", "kind-of", None, 3), ("a", None, "kind-of", None, 4), ("a", "b", None, None, 5), ("b", "a", "uses", None, 6)],
        "src string, dst string, relation string, why string, child int",
    )
    nodes = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "id string")
    assert [tuple(r) for r in parent_links(edges, nodes, ["kind-of"]).select("tree", "child", "parent").collect()] == [("kind-of", "a", "b")]
