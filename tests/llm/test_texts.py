import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import markup, mixing, reading
from barloom.llm.splitting import split_items, split_text
from barloom.llm.term_weights import FUNCTION_WORDS, log_entropy

# terms


def test_log_entropy(spark):
    rows = [("a", "Band band filters, the BAND x 20", 1), ("a", "Band band filters, the BAND x 20", 1), ("b", "band trend", 2), ("c", "the of", 3), ("d", None, 4), ("e", "", 5), (None, "band", 6)]
    got = {(r.id, r.term): r for r in log_entropy(spark.createDataFrame(rows, "id string, summary string, term int"), "id", "summary").collect()}
    assert set(got) == {("a", "band"), ("a", "filters"), ("a", "20"), ("b", "band"), ("b", "trend")}
    h = -(0.75 * math.log(0.75) + 0.25 * math.log(0.25)) / math.log(2)
    assert got["a", "band"].tf == 3 and got["a", "band"].df == 2 and got["a", "band"].weight == pytest.approx(math.log(4) * (1 - h))
    assert got["b", "trend"].weight == pytest.approx(math.log(2))
    one = log_entropy(spark.createDataFrame([("a", "alone alone")], "id string, summary string"), "id", "summary").first()
    assert one.weight == pytest.approx(math.log(3))
    assert log_entropy(spark.createDataFrame([], "id string, summary string"), "id", "summary").count() == 0
    assert "the" in FUNCTION_WORDS


# pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .,\n\t\r!é市。、」𝒳", max_size=400), st.integers(8, 60), st.integers(0, 3))
def test_pieces_cover_the_text(text, limit, overlap):
    pieces, longest = split_text(text, limit, overlap)
    body = text.strip(" \t\r\n")
    if not body:
        assert pieces == []
        return
    assert text[pieces[0][0] : pieces[-1][1]] == body
    assert longest == max(map(len, pd.Series([body]).str.split(r"[ \t\r\n]+", regex=True)[0]))
    covered = np.zeros(len(text), bool)
    for a, b, _ in pieces:
        assert 0 < b - a <= limit
        covered[a:b] = True
    assert all(covered[i] for i, c in enumerate(text) if c not in " \t\r\n")
    for (a, b, kind), (c, d, _) in zip(pieces, pieces[1:]):
        assert a < c and d > b and (b - c >= overlap or text[b:c].strip(" \t\r\n") == "" and overlap == 0)
    if longest <= limit - 2 * overlap - 1 and overlap == 0:
        assert all(k != "hard" for _, _, k in pieces)


def test_cuts_prefer_strong_boundaries():
    text = "One two three four.\n\nFive six seven eight nine ten eleven twelve."
    assert [text[a:b] for a, b, _ in split_text(text, 32, 0)[0]][0] == "One two three four."
    assert split_text("x" * 50, 20, 5)[0][0] == (0, 20, "hard")


def test_cuts_in_scripts_without_blanks():
    sentence = "市场" * 11 + "上涨。"  # 25 characters
    text = sentence * 150
    pieces, _ = split_text(text, 2000, 200)
    assert len(pieces) > 1 and {k for _, _, k in pieces[:-1]} == {"sentence"}
    assert all(text[b - 1] == "。" for _, b, _ in pieces) and all(a % 25 == 0 for a, _, _ in pieces)
    quoted = split_text("「" + "値" * 10 + "。」" + "値" * 30, 24, 0)[0]
    assert quoted[0] == (0, 13, "sentence")
    assert split_text("値" * 15 + "、" + "値" * 15, 20, 0)[0][0] == (0, 16, "clause")
    assert split_text('He said "stop." Then he went on', 20, 0)[0][0] == (0, 15, "sentence")


def test_split_items(spark):
    rows = [("d", "1", None, "k"), ("d", "2", "", "k"), ("d", "3", " \n", "k"), ("d", "4", "short", "k"), ("d", "5", "word " * 300_000, "k")]
    got = split_items(spark.createDataFrame(rows, "item string, item_key string, content string, cut string"), ["item", "item_key"], "content", limit=2000, overlap=200, with_text=True)
    pdf = got.toPandas()
    assert set(pdf.item_key) == {"4", "5"} and pdf[pdf.item_key == "4"].piece.tolist() == ["short"] and (pdf.piece.str.len() <= 2000).all()
    with pytest.raises(ValueError):
        split_items(got, ["item"], "piece", limit=10, overlap=6)


# markup


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("The P&L of the S&P sleeve; R&D; fees < 50 and > 20.", set()), ("A fee of $5 to $7 per lot; at $20 or $3.", set()), ("Paths such as C:\\temp\\new are local.", set()),
        ("2 * 3 * 4, 50% * 2, close_adj_raw, x == y, 3^2 ~ 4", set()), ("The #1 rule [see note 3] | all in {fast, slow}", set()), ("# Head", {"markdown"}), ("Title\n=====", {"markdown"}),
        ("Title\n-----\ntext", {"markdown"}), ("para\n\n-----", set()), ("- item", {"markdown"}), ("  * nested", {"markdown"}), ("3) three", {"markdown"}), ("> quote", {"markdown"}), ("a **b** c", {"markdown"}),
        ("a __b c__ d", {"markdown"}), ("a ***b*** c", {"markdown"}), ("~~gone~~", {"markdown"}), ("[a](http://x \"t\")", {"markdown"}), ("![a](i.png)", {"markdown"}), ("[a][3]\n\n[3]: http://x", {"markdown"}),
        ("`<i>x</i> **b**`", {"markdown"}), ("```\n<b>x</b> $a$ == [[a]] ==\n```", {"markdown"}), ("~~~~text\n~~~\n<b>\n~~~~\n", {"markdown"}), ("| a | b |\n|---|:-:|\n| 1 | 2 |", {"markdown"}), ("| a | b |\n| 1 | 2 |", set()),
        ("a<br/>b", {"html"}), ("<!-- draft\n # no -->", {"html"}), ("a &mdash; b", {"html"}), ("&#955; &#x3c3;", {"html"}), ("&nosuch; & &x", set()), ("<pre><code>## k\n**x** $y$</code></pre>", {"html"}), ("<div\n data-k='a>b'>x</div>", {"html"}), ("<unknown>", set()),
        ("== Head ==", {"wiki"}), ("'''b''' is ''i''", {"wiki"}), ("[[A|b]]", {"wiki"}), ("[https://x the page]", {"wiki"}), ("{{cite|x}}", {"wiki"}), ('{| class="w"\n|-\n| a || b\n|}', {"wiki"}), ("{{Infobox a\n|b={{c}}\n}} t", {"wiki"}),
        ("\\textbf{a}", {"latex"}), ("where $\\frac{a}{b}$ holds", {"latex"}), ("$$\na_b*c*\n$$", {"latex"}), ("\\(a\\) and \\[b\\]", {"latex"}), ("\\begin{itemize}\n\\item a\n\\end{itemize}", {"latex"}), ("\\begin{verbatim}\n## and **\n<td>\n\\end{verbatim}", {"latex"}),
        ("# A\r\n\r\n<p>b\r\r'''c''' \\emph{d}", {"markdown", "html", "wiki", "latex"}), ("", set()), ("\U00100000 text", set()),
    ],
)
def test_kinds(text, kinds):
    assert markup.Page(text).kinds == kinds


def test_clean_text_keeps_structure():
    text = "# One\n\nA **bold** <i>word</i> &amp; [link](u) $x_1$.\n\n- a\n  - b\n\n```python\nx = '**y**'\n```\n\n== Two ==\n\n\\begin{equation}\na = b\n\\end{equation}\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\n<h3>Three</h3>\n<ul><li>c</li><li>d</li></ul>"
    clean = markup.render(markup.Page(text).blocks)
    assert clean == "# One\n\nA bold word & link $x_1$.\n\n- a\n  - b\n\n```\nx = '**y**'\n```\n\n## Two\n\n$$a = b$$\n\nh | i\n1 | 2\n\n### Three\n\n- c\n- d"


def test_template_is_left_out(spark):
    page = lambda i: f"# Shop news\n\nHome | About | Contact\n\n## Item {i}\n\nText number {i} tells something.\n\n- share\n- point {i}\n\nAll rights reserved."
    rows = [("d", str(i), "h", page(i), None) for i in range(8)] + [("d", "x", None, page(9), None), ("d", "y", "solo", page(10), None), ("d", "n", "h", None, None), ("d", "e", "h", "", None)]
    got = {r.item_key: r for r in markup.clean_markup(spark.createDataFrame(rows, "item string, item_key string, host string, content string, clean string"), ["item", "item_key"], "host", "content").collect()}
    assert got["3"].n_template >= 4 and got["3"].clean == "## Item 3\n\nText number 3 tells something.\n\n- point 3"
    assert got["x"].n_template == got["y"].n_template == 0 and got["n"].clean is None and got["e"].markups == []


def test_template_counts_all_pages(spark):
    """A node on half of a host's pages is template on each of them, one on fewer is content, whatever the page."""
    page = lambda i: f"# Item {i}\n\n" + "Follow us.\n\n" * (i % 2) + "A fifth.\n\n" * (i % 5 == 0) + f"Text {i}."
    rows = [("d", str(i), f"h{h}", page(i)) for h in range(12) for i in range(40)]
    got = markup.clean_markup(spark.createDataFrame(rows, "item string, item_key string, host string, content string"), ["item", "item_key", "host"], "host", "content").collect()
    assert len(got) == 480 and all(r.n_template == int(r.item_key) % 2 for r in got)
    assert all(r.clean == page(int(r.item_key)).replace("Follow us.\n\n", "") for r in got)


def test_template_is_joined_when_large(spark, monkeypatch):
    rows = [("d", str(i), "h", f"# Item {i}\n\nFollow us.") for i in range(6)] + [("d", "x", "solo", "# Item 1\n\nFollow us.")]
    monkeypatch.setattr(markup, "BROADCAST_CHARS", 0)
    got = markup.clean_markup(spark.createDataFrame(rows, "item string, item_key string, host string, content string"), ["item", "item_key"], "host", "content").collect()
    assert {r.item_key: r.n_template for r in got} == {**{str(i): 1 for i in range(6)}, "x": 0}


def test_sections_have_their_documents_source(spark, tmp_path):
    from barloom.llm.queries import QUERIES

    docs = [(i, "a" if i < 6 else "b", f"Chapter {i}") for i in range(60)]
    parts = [(i, f"s{i}", "x", f"Part {i}.\n\n" + ("Desk A, all rights reserved." if i < 6 else f"End {i}.")) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, source string, content string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(parts, "doc_id long, slug string, anchor string, content string").write.parquet(str(tmp_path / "sections.parquet"))
    got = {r.item_key: r for r in QUERIES["p6_clean"](spark, str(tmp_path)).where("item = 'section'").collect()}
    assert len(got) == 60 and got["s3#x"].clean == "Part 3." and got["s7#x"].clean == "Part 7.\n\nEnd 7."


def test_no_size_limits_of_markup():
    long = "word " * 3000
    page = markup.Page(f"\\section{{{long}}} and \\textbf{{a {long}}} behind")
    assert page.blocks[0] == ("h2", long.strip(), ()) and "}" not in markup.render(page.blocks)
    many = " ".join(f"`x{i}`" for i in range(70_000))
    page = markup.Page(many + "\n\n<b>b</b> `# no` \U00100000\U0010fffd")
    assert page.kinds == {"markdown", "html"} and markup.render(page.blocks) == many + "\n\nb `# no` \U00100000\U0010fffd"
    deep = markup.Page("\\emph{" * 5000 + "x" + "}" * 5000)
    assert markup.render(deep.blocks) == "x" and deep.kinds == {"latex"}


def test_containers_nest():
    page = markup.Page("<div><nav>\n<ul><li>Home</li><li>Shop</li></ul></nav><p>Text</p></div>tail</section>")
    assert page.blocks == [("div", "", [("nav", "", [("list", "", [("li", "Home", ("-", 0)), ("li", "Shop", ("-", 0))])]), ("p", "Text", ())]), ("p", "tail", ())]
    assert markup.render(page.blocks) == "- Home\n- Shop\n\nText\n\ntail"


def test_nested_template(spark):
    page = lambda i: f"<div><nav>Home</nav><div>Story {i} is told.</div><footer>All rights reserved.</footer></div>"
    rows = [(str(i), "h", page(i)) for i in range(6)]
    got = markup.clean_markup(spark.createDataFrame(rows, "k string, host string, content string"), ["k"], "host", "content").collect()
    assert all(r.n_template == 2 and r.clean == f"Story {r.k} is told." for r in got)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=9), st.lists(st.sampled_from("abcdef"), max_size=9))
def test_matching_is_a_common_order(xs, ys):
    t = lambda v: ("page", "", tuple(("p", x, ()) for x in v))
    pairs = sorted(markup.simple_tree_matching(t(xs), t(ys))[1])
    assert all(p[0] < q[0] and a[0] < b[0] for (p, a), (q, b) in zip(pairs, pairs[1:]))
    if len(set(xs)) == len(xs) and xs == ys:
        assert len(pairs) == len(xs)


def test_long_pages_are_matched_fast():
    import time

    t = lambda v: ("page", "", tuple(("p", x, ()) for x in v))
    a, b = [f"same {i}" if i % 3 else f"a {i}" for i in range(6000)], [f"same {i}" if i % 3 else f"b {i}" for i in range(6000)]
    began = time.time()
    assert len(markup.simple_tree_matching(t(a), t(b))[1]) == 6000 and time.time() - began < 5


def test_tree_matching():
    t = lambda *xs: ("page", "", tuple(("p", x, ()) for x in xs))
    size, pairs = markup.simple_tree_matching(t("a", "b", "c"), t("x", "a", "c"))
    assert ((0,), (1,)) in pairs and ((2,), (2,)) in pairs and size >= 3


# mixes

DOCS = "doc_id long, text string, source string, shard int"
AIMS = "mix_id string, source string, target_weight double, max_repeats int, budget_tokens long"


def test_mixes(spark):
    docs = [(i, "steady bands filter the open trades " * (1 + i % 5), "big" if i % 3 else "hot", 1) for i in range(600)]
    docs += [(1000 + i, "small source text", "small", 1) for i in range(10)] + [(2000, None, "big", 1), (2001, "", "big", 1), (2002, "no source", None, 1), (0, docs[0][1], "hot", 1)]
    aims = [("m", "big", 2.0, 3, 9000), ("m", "hot", 1.0, 3, 9000), ("m", "small", 1.0, 4, 9000), ("m", "none", 1.0, 2, 9000), ("z", "big", None, 3, 100), ("z", "hot", -1.0, 3, 100), (None, "big", 1.0, 1, 5), ("z", "small", 1.0, 0, 100)]
    mix = mixing.mix_sources(spark.createDataFrame(docs, DOCS), spark.createDataFrame(aims, AIMS), block_tokens=200, shard_tokens=1500, bucket_docs=40)
    draw, shares = mix.draw.toPandas(), mix.shares.toPandas().set_index(["mix_id", "source"])
    m = draw[draw.mix_id == "m"]
    assert shares.loc[("m", "big"), "quota_tokens"] == 3600 and 3600 - 40 < shares.loc[("m", "big"), "n_tokens"] <= 3600
    assert shares.loc[("m", "small"), "most_uses"] == 4 and shares.loc[("m", "small"), "short"] and shares.loc[("m", "none"), "n_tokens"] == 0
    assert m.groupby("source").n_tokens.sum().to_dict() == {s: shares.loc[("m", s), "n_tokens"] for s in ("big", "hot", "small")}
    assert not m.duplicated(["doc_id", "copy_no"]).any() and (m.groupby("doc_id").size() <= 4).all() and not m.doc_id.isin([2000, 2001, 2002]).any()
    sizes = m.groupby("shard").n_tokens.sum()
    assert len(sizes) > 3 and sizes.max() < 2.5 * sizes.mean()
    # a shard's blocks are exact ranges of the running sum: sizes differ by a block and the documents at its ends
    assert sizes.max() - sizes.min() < 3 * 200 + 8 * 40
    few = mixing.mix_sources(spark.createDataFrame(docs, DOCS), spark.createDataFrame(aims, AIMS), block_tokens=200, shard_tokens=1500, bucket_docs=40, subtree=2).draw.toPandas()
    assert set(map(tuple, few[["doc_id", "copy_no", "shard"]].values)) == set(map(tuple, draw[["doc_id", "copy_no", "shard"]].values))
    assert sorted(m[m.shard == 0].position) == list(range(1, int((m.shard == 0).sum()) + 1))
    assert abs(shares.loc["m"].actual_share.sum() - 1) < 1e-9 and len(draw[draw.mix_id == "z"]) == 0
    empty = mixing.mix_sources(spark.createDataFrame([], DOCS), spark.createDataFrame([], AIMS))
    assert empty.draw.count() == 0 and empty.shares.count() == 0


def test_splitting_tree():
    root = ("m", ["a", "b", "c", "d"], 7, 60, 0, 7, [17, 3, 0, 40], [0, 0, 0, 0])
    leaves = list(mixing.descend(root, 1, 5))
    assert [x[4:6] for x in leaves] == [(i, i + 1) for i in range(7)]
    counts, first = np.array([x[6] for x in leaves]), np.array([x[7] for x in leaves])
    assert counts.sum(0).tolist() == [17, 3, 0, 40] and np.ptp(counts.sum(1)) <= 1 and (counts >= 0).all()
    assert (first == np.cumsum(counts, 0) - counts).all()
    # the same leaves by way of subtrees
    assert [y for x in mixing.descend(root, 3, 5) for y in mixing.descend(x, 1, 5)] == leaves


def test_large_blocks():
    """Block counts beyond 10**9, and the same law as the generator's where both can be used."""
    big = [3 * 10**9, 10**9, 0, 7]
    left = mixing.split_counts(big, 2 * 10**9, np.random.default_rng(1))
    assert sum(left) == 2 * 10**9 and abs(left[0] - 1.5 * 10**9) < 10**6 and 0 <= left[3] <= 7
    rng = np.random.default_rng(2)
    x = np.array([mixing.hypergeometric(2 * 10**9, 30, 10**9, rng) for _ in range(4000)])
    assert abs((10**9 - x).mean() - 30 * 10**9 / (2 * 10**9 + 30)) < 0.25


# reading level


def test_sentences_and_words():
    assert reading.sentences("One e.g. two. Three! Four? five") == 4
    assert reading.sentences("Wait... what? 3.5 % is it, i.e. all (cf. page 2).") == 3
    assert reading.sentences("...") == 0 and reading.sentences("") == 0
    assert reading._WORD.findall("well-known don't x2 naïve") == ["well-known", "don't", "x", "naïve"]


def test_levels_hold_out(spark):
    """Fitted on half of the graded texts, the level agrees with most readers of the other half."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/reading_labels.parquet")
    from pyspark.sql import functions as F

    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    graded = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    got = reading.reading_levels(graded, labels.where(half)).join(labels.where(~half), "doc_id").where("n_words > 0").toPandas()
    rank = {g: i for i, g in enumerate(reading.GRADES)}
    a, b = got.level.map(rank), got.grade.map(rank)
    assert len(got) > 100 and (a == b).mean() > 0.75 and np.corrcoef(got.score, b)[0, 1] > 0.75


def test_levels_edges(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "123 !!", None, "a"), (4, "One word.", "de", "a"), (5, "word " * 200_000, "en", "a"), (4, "One word.", "de", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, level string")
    none = spark.createDataFrame([], "doc_id long, rater string, grade string")
    got = [(r.doc_id, r.n_words, r.level) for r in reading.reading_levels(docs, none).collect()]
    assert sorted(got, key=lambda r: r[0]) == [(1, 0, None), (2, 0, None), (3, 0, None), (4, 2, "middle"), (4, 2, "middle"), (5, 200_000, "middle")]
    odd = spark.createDataFrame([(4, "r", "easy"), (4, "r", "easy"), (4, None, "hard"), (None, "r", "easy"), (4, "q", None)], "doc_id long, rater string, grade string")
    assert reading.reading_levels(docs, odd).count() == 6
    assert reading.reading_levels(docs.limit(0), odd).count() == 0


@pytest.mark.parametrize(("n", "want"), [(100, 1.0), (150, (1.0 + 0.51) / 2), (200, (1.0 + 0.01) / 2), (250, (1.0 + 0.01 + 0.01) / 3)])
def test_diversity_reads_to_the_end(n, want):
    letters = "abcdefghij"
    words = [a + b for a in letters for b in letters] + ["same"] * (n - 100)
    known = reading._Words(None)
    known.learn(set(words))
    assert reading.text_features(" ".join(words), words, known)[4] == pytest.approx(want)


def test_word_rarity_is_exact(spark, monkeypatch):
    monkeypatch.setattr(reading, "HELD_WORDS", 3)  # counts are passed on in parts
    docs = spark.createDataFrame([("a b c d e f a",), ("A b",), (None,), ("",)], "text string")
    got = reading.word_rarity(docs, "text")
    assert got == pytest.approx({"a": math.log(3), "b": math.log(4.5), **{w: math.log(9) for w in "cdef"}})
    monkeypatch.setattr(reading, "LEAST_SHARE", 0.2)
    assert set(reading.word_rarity(docs, "text")) == {"a", "b"}
    assert reading.word_rarity(docs.limit(0), "text") == {}
