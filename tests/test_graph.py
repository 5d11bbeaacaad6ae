import pytest

from barloom.operators import graph_store as gs
from barloom.operators.graph import Graph, NodeNotFound, cap, fuse, query_terms, variants

NODES = "id string, name string, primitive string, summary string, status string, epistemic string, inputs map<string,string>, params map<string,struct<ptype:string,pmin:double,pmax:double,preset:string>>, outputs map<string,struct<otype:string,units:string,lo:double,hi:double,canonical_name:string,description:string>>, props map<string,string>, src string"
EDGES = "src string, dst string, relation string, why string, id string"


def node(i, name, summary=None, status="ratified", primitive="Concept", **more):
    out = {"out": ("float", "percent", more.get("lo"), more.get("hi"), "c", "a reading")} if more.get("outputs") else None
    return (i, name, primitive, summary, status, "observed", more.get("inputs"), {"window": ("int", 1.0, 5.0, "3")} if more.get("params") else None, out, more.get("props"), "clash")


@pytest.fixture(scope="module")
def g(spark):
    nodes = [
        node("concept:technical-analysis", "Technical analysis"), node("concept:momentum", "Momentum", "rate of change"), node("concept:trend", "Trend", "the direction of prices"),
        node("procedure:rsi", "RSI", "a momentum oscillator", primitive="Procedure", inputs={"close": "bar close"}, params=True, outputs=True, lo=0.0, hi=100.0, props={"formula": "wilder averages", "explanation": "see https://x.invalid/zones for zones"}),
        node("procedure:run-test", "run_test", None, "draft", "Procedure", outputs=True), node("concept:lonely", "Lonely", None, None), node("property:role", "Role"), node("procedure:rsi", "RSI", "a momentum oscillator", primitive="Procedure", inputs={"close": "bar close"}, params=True, outputs=True, lo=0.0, hi=100.0, props={"formula": "wilder averages", "explanation": "see https://x.invalid/zones for zones"}),
        (None, "x", *[None] * 8, "clash"),
    ]
    edges = [
        ("concept:momentum", "concept:technical-analysis", "KIND_OF", "divides it", "e"), ("concept:trend", "concept:technical-analysis", " kind-of ", "divides it", "e"), ("procedure:rsi", "concept:momentum", "instance-of", "measures zones", "e"),
        ("procedure:rsi", "concept:momentum", "Instance Of", "another why", "e"), ("procedure:run-test", "concept:momentum", "about", "tests it", "e"), ("procedure:run-test", "procedure:rsi", "uses", None, "e"), ("procedure:rsi", "property:role", "has-role", "filters", "e"),
        ("procedure:rsi", "nowhere", "uses", None, "e"), (None, "procedure:rsi", "uses", None, "e"), ("procedure:rsi", "concept:trend", None, None, "e"),
    ]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)).materialise()


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_cleaning(g):
    assert g.edges.count() == 6 and g.nodes.count() == 7
    assert {(r.what, r.value): r.n for r in g.stats().collect()}["relation", "kind-of"] == 2


def test_resolution(g):
    assert g.resolve("procedure:rsi") == "procedure:rsi" and g.resolve("rsi") == "procedure:rsi"
    assert g.resolve("procedure:run_test") == "procedure:run-test" and g.resolve("run-test") == "procedure:run-test" and g.resolve("lonel") == "concept:lonely"
    with pytest.raises(NodeNotFound) as e:
        g.resolve("concept")
    assert len(e.value.near) == 4


def test_traversal(g):
    assert ids(g.ancestors("RSI")) == ["concept:momentum", "concept:technical-analysis"]
    assert ids(g.descendants("concept:technical-analysis")) == ["concept:momentum", "concept:trend", "procedure:rsi"]
    assert ids(g.under("momentum")) == ["procedure:rsi", "procedure:run-test"] == ids(g.in_class("momentum"))
    assert ids(g.bearers("property:role")) == ["procedure:rsi"] and ids(g.classes()) == ["concept:momentum", "concept:trend"]
    assert {(r.direction, r.relation, r.id) for r in g.neighbors("RSI", category="structural").collect()} == {("out", "instance-of", "concept:momentum")}
    assert [r.id for r in g.neighbors("RSI", why="filter").collect()] == ["property:role"]
    nodes, edges = g.subgraph("RSI", 1)
    assert nodes.count() == 4 and edges.count() == 4
    assert g.subgraph("RSI", 3, max_nodes=2)[0].count() == 2


def test_paths(g):
    assert g.path("property:role", "concept:trend") == ["property:role", "procedure:rsi", "concept:momentum", "concept:technical-analysis", "concept:trend"]
    assert g.path("RSI", "RSI") == ["procedure:rsi"] and g.path("RSI", "Lonely") is None
    assert sorted(r.way for r in g.all_paths("procedure:run-test", "concept:momentum", 3).items.collect()) == [["procedure:run-test", "concept:momentum"], ["procedure:run-test", "procedure:rsi", "concept:momentum"]]


def test_search(g):
    assert [r.id for r in g.find("momentum").collect()] == ["concept:momentum", "procedure:rsi"]
    assert ids(g.find("wilder oscillators")) == ["procedure:rsi"] and ids(g.find("oscillator zzz")) == ["procedure:rsi"]
    assert ids(g.find("zones")) == ["procedure:rsi"] and g.find("invalid").count() == 0  # links are no content
    assert ids(g.find(requires="close", param="window", status="ratified")) == ["procedure:rsi"]
    assert ids(g.find(kind="momentum", primitive="Procedure")) == ["procedure:rsi", "procedure:run-test"]
    for bad in ({"query": "?"}, {"status": "nope"}, {"requires": "nope"}, {"param": "nope"}):
        with pytest.raises(ValueError):
            g.find(**bad)
    assert query_terms("What is the RSI of it?") == ["rsi"] and query_terms("the of") == ["the", "of"] and variants("zones") == ["zones", "zon", "zone"]


def test_search_reads_reasons_of_outgoing_edges(g):
    assert ids(g.find("divides")) == ["concept:momentum", "concept:trend"]  # no word of it in the nodes
    hay = {r.id: r.t4 for r in g.haystacks().collect()}
    assert len(hay) == 7 and hay["procedure:rsi"].endswith("another why filters") and "divides" not in hay["concept:technical-analysis"]


def test_outputs_and_ask(g, spark):
    assert [r.id for r in g.outputs(bounded=True).collect()] == ["procedure:rsi"] and g.outputs(name="OUT", units="percent").count() == 2
    assert g.ask("zzzz qqqq").count() == 0
    got = {r.id: r.hops for r in g.ask("oscillator").collect()}
    assert got["procedure:rsi"] == 0 and got["concept:momentum"] == 1
    fused = fuse(spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "y", 1), ("b", "z", 2)], "ranking string, id string, rank int")).collect()
    assert [r.id for r in fused] == ["y", "x", "z"]
    assert cap(g.nodes, 2).truncated and cap(g.nodes, None).total == 7


def test_registered_ask_fuses_meaning_and_vectors(g, spark, tmp_path):
    from barloom.queries_graph import graph_ask

    nodes = [node("concept:a", "Bullish envelope", "which filters momentum"), node("concept:b", "Plain"), node("concept:c", "Silent")]
    spark.createDataFrame(nodes, NODES).write.parquet(str(tmp_path / "nodes.parquet"))
    spark.createDataFrame([], EDGES).write.parquet(str(tmp_path / "edges.parquet"))
    unit = [1.0] + [0.0] * 63
    vectors = [(7, "dense", unit, "concept:c"), (8, "other", unit, "concept:b"), (9, "dense", unit, "concept:gone")]
    spark.createDataFrame(vectors, "vec_id long, index_name string, vec array<float>, id string").write.parquet(str(tmp_path / "vectors.parquet"))
    got = {r.id: r.score for r in graph_ask(spark, str(tmp_path)).collect()}
    assert got["concept:c"] >= 1 / 6 - 1e-9 and "concept:gone" not in got and got["concept:a"] >= 2 / 6 - 1e-9


def test_ask_over_more_names_than_a_driver_holds(spark, tmp_path):
    """420,000 numbers that stand in one node each, beside shared words."""
    from barloom.queries_graph import graph_ask

    e = "CASE WHEN id % 4 = 0 THEN 'momentum' ELSE 'other' END"
    nodes = spark.range(6000).selectExpr("concat('concept:n', id) AS id", f"concat({e}, ' ', {e}) AS name", "'Concept' AS primitive", f"concat({e}, ' ', concat_ws(' ', transform(sequence(0, 69), i -> concat('t', id, 'x', i)))) AS summary")
    empty = spark.createDataFrame([], NODES)
    nodes.unionByName(empty.drop("src"), allowMissingColumns=True).write.parquet(str(tmp_path / "nodes.parquet"))
    edges = [("concept:n1", "concept:n4", "kind-of", "said", "x"), ("concept:n1", "concept:n4", "Kind of", "a reason", "x"), ("concept:n2", "concept:gone", "uses", "lost", "x"), ("concept:gone", "concept:n4", "uses", "lost", "x")]
    spark.createDataFrame(edges, EDGES).write.parquet(str(tmp_path / "edges.parquet"))
    spark.createDataFrame([(7, "dense", [1.0] * 64, "concept:n1")], "vec_id long, index_name string, vec array<float>, id string").write.parquet(str(tmp_path / "vectors.parquet"))
    got = {r.id: r for r in graph_ask(spark, str(tmp_path)).collect()}
    assert got["concept:n1"].hops == 0 and got["concept:n4"].hops in (0, 1) and "concept:gone" not in got
    meant = [i for i, r in got.items() if r.hops == 0 and i != "concept:n1"]
    assert len(meant) >= 60 and all(int(i.removeprefix("concept:n")) % 4 == 0 for i in meant)


def test_store(spark, tmp_path):
    n = lambda *rows: spark.createDataFrame(list(rows), "id string, primitive string, status string")
    e = lambda *rows: spark.createDataFrame(list(rows), "src string, dst string, relation string")
    s = gs.GraphStore(spark, str(tmp_path / "store"))
    assert s.published() == 0 and s.history().count() == 0
    first = s.begin_generation()
    assert (first, s.begin_generation()) == (1, 2)  # two writers don't get the same number
    s.write(1, n(("a", "Concept", "ok"), ("b", "Concept", "ok")), e(("a", "b", "kind-of")))
    s.flip(1)
    s.write(2, n(("a", "Concept", "new"), ("c", "Property", "ok")), e(("a", "c", "uses")))
    s.flip(2)
    assert {(r.entity, r.change) for r in s.history().where("generation = 2").collect()} == {("a", "revised"), ("b", "invalidated"), ("c", "generated"), ("a|b|kind-of", "invalidated"), ("a|c|uses", "generated")}
    assert [r.change for r in s.history(entity="b").collect()] == ["invalidated", "generated"]
    assert s._numbers("nodes") == [2]  # what is older is purged
    s.purge_node("c")
    assert s.published() == 3 and s.read("nodes").count() == 1 and s.read("edges").count() == 0 and s.counts().first().n == 1
    for bad in (e(("a", "a", "kind-of")), e(("a", "b", "kind-of"), ("b", "c", "kind-of"), ("c", "a", "kind-of")), e(("a", "b", "likes"))):
        with pytest.raises(ValueError):
            s.write(4, n(("a", "Concept", "ok")), bad)
    with pytest.raises(ValueError):
        s.write(4, n(("a", "Thing", "ok")), e(("a", "b", "uses")))
    s.write(4, n(("a", "Concept", "ok")), e(("a", "b", "kind-of"), ("b", "a", "part-of")))  # each relation stands alone


def test_store_reseed(spark, tmp_path):
    n = lambda *rows: spark.createDataFrame(list(rows), "id string, primitive string, status string, created_at string")
    e = lambda *rows: spark.createDataFrame(list(rows), "src string, dst string, relation string")
    s = gs.GraphStore(spark, str(tmp_path / "store"))
    s.mark_reseed()
    g = s.begin_generation()
    s.write(g, n(("a", "Concept", "ok", "t1"), ("b", "Concept", "ok", "t1")), e(("a", "b", "uses")))
    s.flip(g)
    s.reseed_seq = None
    s.flip(s.add(n(("draft", "Concept", "draft", "t2")), e(("draft", "a", "about"))))
    assert s.mark_reseed() == 2
    g = s.add(n(("a", "Concept", "ok", "t3")), None)
    nodes, edges = s.end_reseed(g)
    assert {(r.id, r.status, r.created_at) for r in nodes.collect()} == {("a", "ok", "t1"), ("b", "deprecated", "t1"), ("draft", "draft", "t2")}
    assert [r.src for r in edges.collect()] == ["draft"]
    before, after = gs.snapshot(s.read("nodes"), ["id"]), gs.snapshot(nodes, ["id"])
    assert {(r.entity, r.change) for r in gs.diff(before, after).collect()} == {("b", "invalidated")}


def test_impact_zones(spark):
    rows = [("module:b", "module:a", "imports"), ("module:a", "class:k", "contains"), ("class:k", "fn:f", "contains"), ("test:t", "module:a", "tests"), ("guardrail:g", "class:k", "implements"),
            ("policy:p", "guardrail:g", "enforces"), ("policy:q", "test:t", "enforces"), ("fn:x", "fn:f", "calls"), ("module:c", "fn:x", "contains")]
    got = {(r.zone, r.id) for r in gs.impact_zones(spark.createDataFrame(rows, "src string, dst string, relation string"), "module:a").collect()}
    assert got == {("dependent", "module:b"), ("test", "test:t"), ("policy", "policy:p"), ("policy", "policy:q"), ("probable_user", "module:c")}


def test_sibling_hops_and_bounds(spark):
    """Two children of one parent are no route unless asked for; the bounds say what they cut."""
    n = spark.createDataFrame([(x, x, None) for x in ("a", "b", "p", "m")], "id string, name string, summary string")
    e = spark.createDataFrame([("a", "p", "kind-of", "x"), ("b", "p", "kind-of", "y"), ("a", "m", "uses", "needs it"), ("m", "b", "uses", "feeds it")], "src string, dst string, relation string, why string")
    g = Graph(n, e)
    ways = lambda r: [x.way for x in r.items.collect()]
    assert ways(g.all_paths("a", "b")) == [["a", "m", "b"]]
    assert ways(g.all_paths("a", "b", sibling_hops=True)) == [["a", "m", "b"], ["a", "p", "b"]]
    assert ways(g.all_paths("a", "b", relations=["kind-of"], sibling_hops=True)) == [["a", "p", "b"]] and g.path("a", "b", relations=["kind-of"]) == ["a", "p", "b"]
    assert g.path("a", "b", why="needs") is None and g.all_paths("a", "a").total == 1
    cut = g.all_paths("a", "b", sibling_hops=True, limit=1)
    assert cut.truncated and cut.total == 2 and cut.note == "showing 1 of 2 paths"
    stopped = g.all_paths("a", "b", max_steps=3)
    assert stopped.truncated and stopped.total == 0 and "stopped before hop 2" in stopped.note


def test_store_questions(spark):
    e = spark.createDataFrame([("a", "b", "kind-of"), ("b", "c", "kind-of"), ("d", "d", "uses")], "src string, dst string, relation string")
    n = spark.createDataFrame([(x, "Concept") for x in "abcdef"], "id string, primitive string")
    assert ids(gs.orphans(n, e)) == ["e", "f"] and ids(gs.disconnected(n, e, spark.createDataFrame([("a",)], "id string"))) == ["d", "e", "f"]
    assert gs.closes_circle(e, "c", "a", "kind-of") and not gs.closes_circle(e, "a", "c", "kind-of") and not gs.closes_circle(e, "c", "a", "uses")
    assert {(r.id, r.depth) for r in gs.impact(e, "c").collect()} == {("b", 1), ("a", 2)}
    vocabulary = spark.createDataFrame([("sub", "top"), ("subsub", "sub"), ("top", None)], "relation string, parent string")
    assert sorted(gs.relation_descendants(vocabulary, "top")) == ["sub", "subsub", "top"] and gs.relation_ancestors(vocabulary, "subsub") == ["sub", "top"]
    assert {r.what: r.share for r in gs.coverage(n, e, ["Concept", "Module"], ["kind-of", "uses"]).collect()} == {"primitive": 0.5, "relation": 1.0}
    assert {tuple(r) for r in gs.circles(e.union(spark.createDataFrame([("c", "a", "kind-of"), ("a", "z", "kind-of")], e.schema))).collect()} == {("kind-of", "a", "b"), ("kind-of", "b", "c"), ("kind-of", "c", "a")}
    named = n.withColumn("name", n.id)
    assert gs.resolve(named, "a") == ["a"] and gs.resolve(named, "A") == ["a"] and gs.resolve(named, "zz") == []
    with pytest.raises(ValueError):
        gs.nodes_by_primitive(n, "Thing")


def test_circles(spark, monkeypatch):
    """Rings, what lies between two of them and self links stay; ways in and out, other relations and mixed ones don't."""
    schema = "src string, dst string, relation string"
    ring = [("a", "b"), ("b", "a"), ("b", "m"), ("m", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("s", "s")]
    off = [("in0", "in1"), ("in1", "a"), ("z", "out0"), ("out0", "out1"), ("p", "q"), ("s", None), (None, "a")]
    rows = [(s, d, "kind-of") for s, d in ring + off] + [("a", "b", "kind-of"), ("q", "p", "part-of"), ("u", "v", "uses"), ("v", "u", "uses"), ("b", "a", "supersedes"), ("a", "b", "supersedes")]
    e, want = spark.createDataFrame(rows, schema), sorted([("kind-of", *r) for r in ring] + [("supersedes", "a", "b"), ("supersedes", "b", "a")])
    assert sorted(tuple(r) for r in gs.circles(e).collect()) == want
    assert gs.circles(e.limit(0)).collect() == [] and gs.circles(e.where("relation = 'uses'")).collect() == []
    monkeypatch.setattr(gs, "ONE_TASK", 3)  # the same in rounds of jobs
    assert sorted(tuple(r) for r in gs.circles(e).collect()) == want


def test_circles_at_the_end_of_a_long_chain(spark):
    """20,000 links lead to a ring and 20,000 away from it; only the ring stays."""
    chain = spark.range(20_000).selectExpr("concat('n', id) as src", "concat('n', id + 1) as dst", "'kind-of' as relation")
    away = spark.range(20_000).selectExpr("concat('m', id) as src", "concat('m', id + 1) as dst", "'kind-of' as relation")
    ring = spark.createDataFrame([("n20000", "r", "kind-of"), ("r", "n20000", "kind-of"), ("r", "m0", "kind-of")], chain.schema)
    assert {tuple(r) for r in gs.circles(chain.union(away).union(ring)).collect()} == {("kind-of", "n20000", "r"), ("kind-of", "r", "n20000")}
