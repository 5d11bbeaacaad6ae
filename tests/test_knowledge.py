import json

import pytest

from barloom.operators.graph import Graph
from barloom.sources import knowledge as k


def test_json_graph(spark, tmp_path, monkeypatch):
    record = {"atoms": [{"id": "a", "title": "A", "kind": "Concept", "props": {"n": 3, "x": "y"}}, {"id": "b", "title": "B", "kind": "Module"}, {"title": "no id"}], "relations": [{"from": "a", "rel": "uses", "to": "b", "why": "w"}, {"from": "a", "rel": "uses", "to": "gone"}]}
    (tmp_path / "g.json").write_text(json.dumps(record))
    nodes, edges = k.read_graph_json(spark, str(tmp_path / "g.json"))
    assert {r.id: r.props for r in nodes.collect()}["a"] == {"n": "3", "x": "y"} and Graph(nodes, edges).edges.count() == 1
    k.write_graph_json(nodes, edges, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/nodes")).count() == 3
    monkeypatch.setenv("BARLOOM_GRAPH", "env")
    assert k.graph_path("given") == "given" and k.graph_path(None, "default") == "env"
    monkeypatch.delenv("BARLOOM_GRAPH")
    with pytest.raises(FileNotFoundError):
        k.graph_path()


def test_chapters(spark, tmp_path):
    for name, text in (("01-Market Basics.md", "# 1. Basics\n\ntext\n\n## Part\n"), ("notes.md", "# N"), ("02-x.txt", "# X"), ("03-big.md", "# B" + "x" * 200)):
        (tmp_path / name).write_text(text)
    rows = k.read_chapters(spark, str(tmp_path), max_chars=100).collect()
    assert [(r.slug, r.title, r.importance) for r in rows] == [("1-market-basics", "Basics", 99)] and len(rows[0].sha) == 64


def test_merge(spark):
    pages = spark.createDataFrame([("Order Flow", "Concept", "s"), ("Book", "Concept", None), ("Book", "Concept", None)], "title string, kind string, summary string")
    link = lambda *rows: spark.createDataFrame(list(rows), "src_title string, relation string, dst_title string, why string")
    nodes, edges = k.merge_pages(pages, link(("Book", "part-of", "Order Flow", "it feeds it")))
    assert {r.id for r in nodes.collect()} == {"concept:order-flow", "concept:book"} and edges.first().dst == "concept:order-flow"
    for bad in ([("Book", "uses", "Order Flow", " ")], [("Book", "uses", "Gone", "w")], [("Book", "uses", "Order Flow", "w")] * 2):
        with pytest.raises(ValueError):
            k.merge_pages(pages, link(*bad))


def test_authored_and_budget():
    doc = "Formula: a / b\nInputs: close\nOutputs:\n    x: ratio\nWarmup: window - 1\n"
    assert k.parse_authored(doc)["Outputs"] == "x: ratio"
    for bad in ("Formula: a\n", doc + "Formula: again\n", "Strange: x\n" + doc, ""):
        with pytest.raises(ValueError):
            k.parse_authored(bad)
    text, cut = k.bounded_json([{"a": "x" * 100}] * 50, 1000)
    assert cut and len(text) <= 1000 and k.bounded_json([], 10) == ("[]", False)
