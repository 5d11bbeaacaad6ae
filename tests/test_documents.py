import re
from collections import Counter

import numpy as np
import pytest

from barloom.operators import documents as d
from barloom.operators import retrieval as r

CHAPTER = "# 3. Bands\n\nIntro on smoothing.\n\nTags: Momentum, trend.\n\n## 3.1 Moving average (MA)\n\nMoving averages smooth prices.\n\n```\n## no heading\n```\n\n### Details\n\nstop loss rules\n\n## Outlook\n\n### Outlook\n\nlast\n"
SCHEMA = "slug string, title string, content string, tags array<string>, anchor string"


@pytest.fixture(scope="module")
def two(spark):
    rows = [("3-bands", "Bands", CHAPTER, ["other"], "x"), ("3-bands", "Bands", CHAPTER, ["other"], "x"), ("4-glossary", "Glossary", "# 4. Glossary\n\n## Terms\n\n| Term | Definition | Abbreviation | Category |\n|---|---|---|---|\n| Stop loss | exits a losing trade | SL, STP | risk |\n| Take profit | exits a winning trade | - | risk |\n\nsmoothed words\n", None, "x")]
    rows += [("5-chart-patterns", "Patterns", "# 5. P\n\n## Head and shoulders\n\ntext\n\n## Wedge\n\n", None, "x"), (None, None, None, None, "x"), ("6-empty", "Empty", "", None, "x"), ("7-indicators", "I", "# 7\n\n## Average True Range (ATR)\n\nx\n", None, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs, d.sections(docs).cache()


def test_sections(two):
    got = {(x.anchor, x.level, x.parent_anchor) for x in two[1].where("slug = '3-bands'").collect()}
    assert got == {("3-1-moving-average-ma", 2, None), ("3-1-details", 3, "3-1-moving-average-ma"), ("outlook", 2, None), ("outlook-1", 3, "outlook")}
    for x in two[1].where("slug = '3-bands'").collect():
        assert CHAPTER[x.start_char : x.end_char].strip() == x.content
    assert d.slugify("Größe & Höhe_x") == "groe-hohe-x" and d.tags_of(CHAPTER) == ["momentum", "trend"]


def test_documents_and_pages(two):
    docs, parts = two
    assert {(x.slug, x.n_sections) for x in d.list_documents(docs, parts).collect()} == {("3-bands", 4), ("4-glossary", 1), ("5-chart-patterns", 2), ("6-empty", 0), ("7-indicators", 1)}
    doc, own = d.get_document(docs, parts, "3-bands", 110)
    assert doc.first().truncated and len(doc.first().content) == 110 and own.count() == 1
    text, at = "", 0
    while at is not None:
        page = d.get_page(docs, parts, "3-bands", view="content", offset=at, max_chars=50).first()
        text, at = text + page.content, page.next_offset
    assert text == CHAPTER
    assert d.get_page(docs, parts, "3-bands").count() == 4 and d.get_page(docs, parts, "3-bands", view="section", anchor="outlook-1").first().content == "last"
    for bad in (("Bad Slug", {}), ("3-bands", {"max_chars": -1}), ("3-bands", {"view": "x"}), ("3-bands", {"offset": -1})):
        with pytest.raises(ValueError):
            d.get_page(docs, parts, bad[0], **bad[1])


def test_stemmer():
    words = "caresses ponies cats agreed plastered motoring conflated hopping falling filing happy relational conditional vileness adjustable replacement adoption probate controlling sky"
    stems = "caress poni cat agre plaster motor conflat hop fall file happi relat condit vile adjust replac adopt probat control sky"
    assert [d.porter_stem(w) for w in words.split()] == stems.split()


def test_search(two):
    docs, parts = two
    found = lambda q, **k: [(x.slug, x.anchor) for x in d.search(docs, parts, q, **k).collect()]
    assert ("3-bands", "3-1-moving-average-ma") in found("moving averages") and ("3-bands", None) in found("moving averages")
    assert found("smoothing")[0][0] == "4-glossary"  # glossary chapters lead
    assert ("3-bands", "3-1-details") in found("SL") and ("3-bands", "3-1-details") not in found("SL", expand=False)
    assert found("") == [] and found("", tags=["MOMENTUM"]) == [("3-bands", None)] and found("zzz") == []
    for odd in ('"unclosed', "title:RSI", "*", "(((", "a AND", "'; --", "\\"):
        found(odd)
    s = d.SynonymRegistry()
    assert s.expand_query("set stop loss") == [["set"], ["stop loss", "sl", "stop-loss", "stoploss"]] and s.get_synonyms("stoploss") == ["sl", "stop loss", "stop-loss"]
    snip = d.snippets(docs.where("slug = '3-bands'").limit(1), "content", "average").first().snippet
    assert "<mark>average</mark>" in snip and len(snip.split()) <= 31


def test_glossary(two):
    terms = d.glossary_terms(*two).cache()
    assert {x.term: x.abbreviation for x in terms.collect()} == {"Stop loss": "SL, STP", "Take profit": None, "Head and shoulders": None, "Wedge": None, "Average True Range": "ATR"}
    assert d.glossary_entry(terms, "stp").first().term == "Stop loss" and d.glossary_entry(terms, "wedge").first().term == "Wedge" and d.glossary_entry(terms, "shoulders").first().term == "Head and shoulders"
    assert d.glossary_entry(terms, "nothing").count() == 0
    assert d.related_terms(terms).count() == 0


def test_dense(spark):
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 2.0]), ("b", [3.0, 3.0]), ("c", None), ("d", [0.0, 0.0]), ("e", [float("nan"), 1.0]), (None, [0.0, 1.0]), ("f", [1.0]), ("g", [0.0, 5.0])]
    got = r.dense_similar(spark.createDataFrame(rows, "id string, vec array<float>"), [0.0, 1.0], 3).collect()
    assert [(x.id, round(x.score, 4)) for x in got] == [("a", 1.0), ("g", 1.0), ("b", 0.7071)]


def test_semantic_index_spans_the_same_space(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(40)]
    topics = [rng.choice(words, 10) for _ in range(4)]
    texts = [(f"d{i}", " ".join(rng.choice(topics[i % 4], 12))) for i in range(80)] + [("n", None), ("e", "")]
    ix = r.build_semantic_index(spark.createDataFrame(texts, "id string, text string"), 4, rounds=8)
    top = [x.id for x in ix.similar(" ".join(topics[2][:5]), 10).collect()]
    assert np.mean([int(t[1:]) % 4 == 2 for t in top]) >= 0.9 and ix.embed("zzz") is None
    assert ix.vectors.count() == 80 and ix.matches(ix.digest)
    np.testing.assert_allclose(ix.components @ ix.components.T, np.eye(4), atol=1e-6)


def latent(texts, width):
    """Items x width by a dense SVD of the same weights, rows of unit length, and the vector of a question."""
    counts = {i: Counter(re.findall(r"[a-z0-9]{2,}", t)) for i, t in texts}
    terms = sorted({w for c in counts.values() for w in c})
    tf = np.array([[counts[i][w] for w in terms] for i, _ in texts], float)
    idf = np.log((1 + len(texts)) / (1 + (tf > 0).sum(axis=0))) + 1
    x = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = np.linalg.svd(x)[2][:width]
    unit = lambda a: a / np.linalg.norm(a, axis=-1, keepdims=True)
    return unit(x @ v.T), lambda words: unit((np.isin(terms, words) * idf) @ v.T)


@pytest.mark.parametrize("block", [32_768, 8])
def test_semantic_index_equals_a_dense_svd(spark, monkeypatch, block):
    monkeypatch.setattr(r, "BLOCK_TERMS", block)
    monkeypatch.setattr(r, "SLICE_TERMS", min(block // 2, 256))
    rng = np.random.default_rng(1)
    topics = [[f"w{t}x{i}" for i in range(8)] for t in range(5)]
    texts = [(f"d{i:03d}", " ".join([*rng.choice(topics[i % 5], 9), *(["own" + str(i), "mine" + str(i)] if i % 3 else []), "all"])) for i in range(150)]
    ix = r.build_semantic_index(spark.createDataFrame(texts, "id string, text string"), 5, rounds=12)
    items, ask = latent(texts, 5)
    got = {x.id: np.array(x.vec) for x in ix.vectors.collect()}
    np.testing.assert_allclose(np.stack([got[i] for i, _ in texts]) @ got["d007"], items @ items[7], atol=1e-4)
    # common words, and words of one item only
    for words in (["w2x1", "w2x3"], ["own4", "w1x0"]):
        want = items @ ask(words)
        near = ix.similar(" ".join(words), 150).collect()
        np.testing.assert_allclose([x.score for x in near], [want[int(x.id[1:])] for x in near], atol=1e-4)
        assert len(near) == 150 and [x.score for x in near] == sorted((x.score for x in near), reverse=True)
    assert ix.embed("nothing") is None and len(ix.terms) == 41 + 200


def test_semantic_index_takes_any_vocabulary(spark):
    """More terms than a driver could hold products of: names and numbers of one item each, and a few shared words."""
    words = "concat_ws(' ', transform(sequence(0, 49), i -> concat('t', id, 'x', i)), transform(sequence(0, 5), i -> concat('topic', id % 3, 'x', i)))"
    ix = r.build_semantic_index(spark.range(9000).selectExpr("concat('d', id) as id", f"{words} as text"), 3, rounds=2)
    assert ix.counts.count() == 450_018 and ix.vectors.count() == 9000
    near = ix.similar("topic2x0 topic2x5", 3000).collect()
    assert all(int(x.id[1:]) % 3 == 2 and x.score > 0.99 for x in near) and ix.similar("topic2x1", 3001).collect()[-1].score < 0.1
    assert int(ix.similar("t5x7", 1).first().id[1:]) % 3 == 2  # a word of d5 only


def test_semantic_index_without_terms(spark):
    ix = r.build_semantic_index(spark.createDataFrame([("a", ""), ("b", None), (None, "word")], "id string, text string"))
    assert ix.vectors.count() == 0 and ix.similar("word").count() == 0


def test_fused_ranks_the_whole_table(spark, tmp_path):
    from barloom.queries_documents import retrieve_fused_dense

    x = np.random.default_rng(5).normal(size=(200, 8))
    x[150] = x[0] * 2
    spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {row.id: row.score for row in retrieve_fused_dense(spark, str(tmp_path)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want: dict = {}
    for q in (0, 199):
        near = [i for i in np.argsort(-(u @ u[q])) if i not in (0, 150)] if q == 0 else list(np.argsort(-(u @ u[q])))
        for rank, i in enumerate(([0, 150] + near if q == 0 else near)[:60], 1):
            want[str(i)] = want.get(str(i), 0) + 1 / (5 + rank)
    assert set(got) == set(want) and "150" in got and all(abs(got[i] - w) < 1e-6 for i, w in want.items())


def test_semantic_documents_weigh_all_bands(spark):
    hay = spark.createDataFrame([("x", "name x", "abbr", "", "detail the", "reason"), ("y", "other", "", "", "", "reason of it")], "id string, t0 string, t1 string, t2 string, t3 string, t4 string")
    docs = {d.id: d.text.split() for d in r.weighted_documents(hay).collect()}
    assert [docs["x"].count(w) for w in ("name", "abbr", "detail", "reason")] == [3, 2, 1, 1]
    ix = r.build_semantic_index(r.weighted_documents(hay), 2)
    assert set(ix.terms) == {"name", "abbr", "detail", "reason", "other"}  # no function words
    assert {d.id for d in ix.similar("the reason", 5).collect()} == {"x", "y"}  # both lack a summary


def test_bounded_answer(spark):
    from barloom.operators.documents import answer, tags_by_slug, validate_request

    body = "# 1. Bands\n\nTags: Trend, volatility\n\n" + "The envelope filters the trend. " * 80
    docs = spark.createDataFrame([(f"{i}-bands", "Bands", body, [f"t{j:02d}" for j in range(20)], "clash") for i in range(6)] + [("9-other", "Other", "Nothing here.", None, "clash")], "slug string, title string, content string, tags array<string>, anchor string")
    parts = spark.createDataFrame([], "slug string, anchor string, title string, level int, content string")
    tags = {r.slug: r.tags for r in tags_by_slug(docs).collect()}
    assert len(tags["0-bands"]) == 22 and "trend" in tags["0-bands"] and tags["9-other"] == []
    got = answer(docs, parts, "envelope", tags=["trend"], limit=3)
    assert (got["returned"], got["total_results"], got["truncated"], got["tags_matched"]) == (3, 6, True, ["trend"])
    first = got["results"][0]
    assert first["tags"][0] == "trend" and len(first["tags"]) == 16 and first["tags_truncated"] and len(first["snippet"]) <= 500 and "<mark>" in first["snippet"]
    assert answer(docs, parts, "envelope", limit=5, most_bytes=1200)["returned"] < 5 and answer(docs, parts, "zzzz")["results"] == []
    for bad in ({"query": "x" * 1001}, {"query": "x", "limit": 101}, {"query": "x", "limit": True}, {"query": "x", "expand": 1}, {"query": "x", "tags": [" "]}, {"query": "x", "tags": ["a"] * 11}):
        with pytest.raises(ValueError):
            answer(docs, parts, **bad)
    for slug in ("a--b", "a-", "-a", "A"):
        with pytest.raises(ValueError):
            validate_request(slug, 10)
