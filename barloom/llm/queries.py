"""Registered queries of this subpackage: name -> Spark query, name -> DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, code_docs, markup, mixing, neighbours, reading, splitting, term_weights

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# 1: most similar vectors for every vector


@register(
    "p1_found",
    """
WITH v AS (SELECT DISTINCT ON (vec_id) vec_id, index_name, list_transform(vec, lambda x: CAST(x AS DOUBLE)) AS v FROM vectors WHERE len(vec) = 64),
w AS (SELECT *, list_inner_product(v, v) AS nn FROM v),
g AS (SELECT * FROM w WHERE nn > 0 AND NOT isnan(nn))
SELECT a.vec_id AS vec_a, b.vec_id AS vec_b FROM g a JOIN g b ON a.index_name = b.index_name AND a.vec_id < b.vec_id
WHERE list_inner_product(a.v, b.v) >= 0.9 * sqrt(a.nn * b.nn)""",
)
def p1_found(spark, sf_dir):
    pairs = neighbours.similar_pairs(table(spark, sf_dir, "vectors"), 0.90)
    return pairs.select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"))


_UNITS = """
WITH v AS (SELECT DISTINCT index_name, vec_id, list_transform(vec, lambda x: CAST(x AS DOUBLE)) AS v FROM vectors WHERE len(vec) = 64 AND vec_id IS NOT NULL),
w AS (SELECT *, sqrt(list_inner_product(v, v)) AS norm FROM v),
u AS (SELECT index_name, vec_id, list_transform(v, lambda x: CAST(x / norm AS FLOAT)) AS unit FROM w WHERE norm > 0 AND NOT isnan(norm)),
c AS (SELECT *, min(vec_id) OVER (PARTITION BY index_name, unit) AS class, count(*) OVER (PARTITION BY index_name, unit) AS members FROM u)
"""


@register(
    "p1_neighbours",
    _UNITS + """, r AS (SELECT * FROM c WHERE vec_id = class),
s AS (SELECT a.index_name, a.class, b.class AS neighbour, list_inner_product(a.unit, b.unit) AS similarity FROM r a JOIN r b ON a.index_name = b.index_name AND a.class <> b.class
  WHERE EXISTS (SELECT 1 FROM c x WHERE x.index_name = a.index_name AND x.class = a.class AND x.vec_id % 50 = 0)
  QUALIFY row_number() OVER (PARTITION BY a.index_name, a.class ORDER BY similarity DESC, neighbour) <= 10)
SELECT index_name, vec_id, class, neighbour, round(CAST(similarity AS DOUBLE), 3) AS similarity FROM c JOIN s USING (index_name, class) WHERE vec_id % 50 = 0""",
)
def p1_neighbours(spark, sf_dir):
    """Ten directions for each asked vec_id; ``class`` and ``neighbour`` stand for all their copies in p1_copies."""
    wide = neighbours.Probing(visit_lists=32, visit_ratio=1.7)
    asked = F.col("id") % 50 == 0
    links, classes = neighbours.similar_vectors(table(spark, sf_dir, "vectors"), k=10, query_filter=asked, probing=wide)
    links = neighbours.by_asked_id(links, classes.where(asked))
    return links.select(F.col("grp").alias("index_name"), F.col("id").alias("vec_id"), F.col("q").alias("class"), F.col("m").alias("neighbour"), F.round(F.col("sim").cast("double"), 3).alias("similarity"))


@register("p1_copies", _UNITS + "SELECT index_name, vec_id, class FROM c WHERE members > 1")
def p1_copies(spark, sf_dir):
    classes = neighbours.copies(table(spark, sf_dir, "vectors"))
    return classes.select(F.col("grp").alias("index_name"), F.col("id").alias("vec_id"), F.col("rep").alias("class"))


# 2: functions paired with their documentation


@register("p2_found")
def p2_found(spark, sf_dir):
    pairs = code_docs.function_docs(table(spark, sf_dir, "nodes"), with_code=True)
    return pairs.where("code != ''").select("node_id", "func_name").distinct()


@register("p2_pairs")
def p2_pairs(spark, sf_dir):
    return code_docs.function_docs(table(spark, sf_dir, "nodes"), with_code=True)


# 4: how distinctive a term is per record

_TERMS = f"""
WITH words AS (
  SELECT id AS node_id, unnest(regexp_extract_all(lower(summary), '[a-z0-9]{{2,}}')) AS term
  FROM (SELECT DISTINCT id, summary FROM nodes WHERE id IS NOT NULL)),
counts AS (SELECT node_id, term, count(*) AS tf FROM words WHERE term NOT IN ({", ".join(f"'{w}'" for w in term_weights.FUNCTION_WORDS)}) GROUP BY 1, 2),
spread AS (SELECT term, count(*) AS df, sum(tf) AS gf, sum(tf * ln(tf)) AS tlt FROM counts GROUP BY 1)
"""


@register("p4_found", _TERMS + "SELECT DISTINCT node_id, term FROM counts JOIN spread USING (term) WHERE tf >= 2 AND df <= 4")
def p4_found(spark, sf_dir):
    scored = term_weights.log_entropy(table(spark, sf_dir, "nodes"), "id", "summary")
    # a weight is never negative: the scores are computed, the two limits are the exact check
    return scored.where("weight >= 0 and tf >= 2 and df <= 4").select(F.col("id").alias("node_id"), "term")


@register(
    "p4_weights",
    _TERMS + "SELECT node_id, term, tf, df, round(ln(1 + tf) * (1 - CASE WHEN n > 1 THEN (ln(gf) - tlt / gf) / ln(n) ELSE 0 END), 6) AS weight "
    "FROM counts JOIN spread USING (term), (SELECT count(DISTINCT node_id) AS n FROM counts)",
)
def p4_weights(spark, sf_dir):
    scored = term_weights.log_entropy(table(spark, sf_dir, "nodes"), "id", "summary")
    return scored.select(F.col("id").alias("node_id"), "term", "tf", "df", F.round("weight", 6).alias("weight"))


# 5: splitting oversized items at natural boundaries

_ITEMS = """
WITH items AS (
  SELECT 'document' AS item, CAST(doc_id AS VARCHAR) AS item_key, content FROM documents
  UNION SELECT 'section', slug || '#' || anchor, content FROM sections),
cut AS (SELECT item, item_key, trim(content, E' \\t\\r\\n') AS body FROM items)
"""


def _items(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("item"), F.col("doc_id").cast("string").alias("item_key"), "content")
    parts = table(spark, sf_dir, "sections").select(F.lit("section").alias("item"), F.concat("slug", F.lit("#"), "anchor").alias("item_key"), "content")
    return docs.union(parts).where("content is not null")


@register(
    "p5_found",
    _ITEMS + "SELECT DISTINCT item, item_key, CASE WHEN list_max(list_transform(string_split_regex(body, '[ \\t\\r\\n]+'), lambda w: length(w))) > 2000 THEN 'unbroken' ELSE 'breakable' END AS form "
    "FROM cut WHERE length(body) > 2000",
)
def p5_found(spark, sf_dir):
    pieces = splitting.split_items(_items(spark, sf_dir), ["item", "item_key"], "content", limit=2000, overlap=200)
    form = F.when(F.col("longest_run") > 2000, "unbroken").otherwise("breakable").alias("form")
    return pieces.where("piece_no = 1").select("item", "item_key", form).distinct()


@register("p5_pieces")
def p5_pieces(spark, sf_dir):
    pieces = splitting.split_items(_items(spark, sf_dir), ["item", "item_key"], "content", limit=2000, overlap=200)
    return pieces.select("item", "item_key", "piece_no", "n_pieces", "start_char", "end_char", "cut").distinct()


# 6: markup residue in text documents


def _pages(spark, sf_dir):
    whole = table(spark, sf_dir, "documents")
    docs = whole.select(F.lit("document").alias("item"), F.col("doc_id").cast("string").alias("item_key"), F.concat(F.lit("documents of "), "source").alias("host"), "content")
    # sections have the source of their document; they are pages of their own kind, since a chapter repeats what its sections hold
    source = whole.where("doc_id is not null and content is not null").groupBy("doc_id").agg(F.min("source").alias("source"))
    parts = table(spark, sf_dir, "sections").join(source, "doc_id", "left")
    parts = parts.select(F.lit("section").alias("item"), F.concat("slug", F.lit("#"), "anchor").alias("item_key"), F.concat(F.lit("sections of "), "source").alias("host"), "content")
    return docs.union(parts).where("content is not null")


@register("p6_found")
def p6_found(spark, sf_dir):
    pages = markup.clean_markup(_pages(spark, sf_dir), ["item", "item_key"], "host", "content")
    return pages.select("item", "item_key", F.explode("markups").alias("markup")).distinct()


@register("p6_clean")
def p6_clean(spark, sf_dir):
    return markup.clean_markup(_pages(spark, sf_dir), ["item", "item_key"], "host", "content").select("item", "item_key", "n_template", "clean").distinct()


# 7: encoding of the whole corpus


@register("p7_ids")
def p7_ids(spark, sf_dir):
    return bpe.encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


# 8: mixing sources to target weights


def _mix(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@register("p8_draw")
def p8_draw(spark, sf_dir):
    return _mix(spark, sf_dir).draw


@register("p8_shares")
def p8_shares(spark, sf_dir):
    return _mix(spark, sf_dir).shares


# 9: reading level

_ABBREVIATIONS = "|".join(reading.ABBREVIATIONS).replace(".", "[.]")


@register(
    "p9_found",
    rf"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '\p{{L}}+(?:[-''’]\p{{L}}+)*') AS words,
  regexp_replace(text, '(^|[^\p{{L}}.])({_ABBREVIATIONS})[.]', '\1\2 ', 'gi') AS plain FROM documents WHERE lang = 'en'),
s AS (SELECT doc_id, len(words) AS n, length(regexp_replace(array_to_string(words, ''), '[^\p{{L}}]', '', 'g')) AS letters,
  len(list_filter(string_split_regex(plain, '[.!?]+(\s+|$)'), lambda x: regexp_matches(x, '\p{{L}}'))) AS ends FROM t)
SELECT DISTINCT doc_id FROM s WHERE n >= 50 AND n >= 20 * ends AND letters >= 5.6 * n""",
)
def p9_found(spark, sf_dir):
    levels = reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))
    # the regression's level gives the candidates (the hardest easy text scores far below any of these), the limits are the exact check
    exact = (F.col("n_words") >= 50) & (F.col("words_per_sentence") >= 20) & (F.col("letters_per_word") >= 5.6)
    return levels.where((F.col("lang") == "en") & (F.col("level") != "easy") & exact).select("doc_id").distinct()


@register("p9_levels")
def p9_levels(spark, sf_dir):
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))
