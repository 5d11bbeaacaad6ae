"""Queries over chapters, sections, and the retrieval vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import documents as d
from barloom.operators import retrieval as r
from barloom.queries import register, table
from barloom.queries_graph import graph


def _two(spark, sf_dir):
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "sections")


@register("doc_sections", "SELECT DISTINCT slug, anchor, title, level, parent_anchor, content, start_char, end_char FROM sections")
def doc_sections(spark, sf_dir):
    return d.sections(table(spark, sf_dir, "documents"))


@register("doc_list", "SELECT slug, title, coalesce(n, 0) AS n_sections FROM documents LEFT JOIN (SELECT slug, count(DISTINCT anchor) AS n FROM sections GROUP BY 1) USING (slug) WHERE slug IS NOT NULL AND content IS NOT NULL")
def doc_list(spark, sf_dir):
    return d.list_documents(*_two(spark, sf_dir))


_SLUG = "(SELECT min(slug) FROM sections)"


@register("doc_get", f"SELECT slug, title, substring(content, 1, 500) AS content, length(content) > 500 AS truncated FROM documents WHERE slug = {_SLUG}")
def doc_get(spark, sf_dir):
    docs, parts = _two(spark, sf_dir)
    return d.get_document(docs, parts, parts.agg(F.min("slug")).first()[0], 500)[0]


@register("doc_page", f"SELECT slug, substring(content, 101, 300) AS content, CASE WHEN length(content) > 400 THEN 400 END AS next_offset FROM documents WHERE slug = {_SLUG}")
def doc_page(spark, sf_dir):
    docs, parts = _two(spark, sf_dir)
    return d.get_page(docs, parts, parts.agg(F.min("slug")).first()[0], view="content", offset=100, max_chars=300)


_WORDS = "regexp_extract_all(lower(concat_ws(' ', title, content)), '[\\p{L}\\p{N}]+')"


def _bm25_sql(terms: list[str]) -> str:
    count = lambda t: f"len(list_filter(w, lambda x: x = '{t}'))"

    def part(name, keys, source):
        c = ", ".join(f"{count(t)} AS c{i}" for i, t in enumerate(terms))
        score = " + ".join(f"greatest(1e-6, ln((s.n - d{i} + 0.5) / (d{i} + 0.5))) * c{i} * 2.2 / (c{i} + 1.2 * (0.25 + 0.75 * len(w) / s.mean))" for i in range(len(terms)))
        df = ", ".join(f"sum(CASE WHEN c{i} > 0 THEN 1 ELSE 0 END) AS d{i}" for i in range(len(terms)))
        every = " AND ".join(f"c{i} > 0" for i in range(len(terms)))
        return f"{name}_t AS (SELECT DISTINCT ON ({keys}) {keys}, {_WORDS} AS w FROM {source}), {name}_c AS (SELECT *, {c} FROM {name}_t), {name} AS (SELECT {keys}, {score} AS score FROM {name}_c, (SELECT count(*) AS n, avg(len(w)) AS mean, {df} FROM {name}_c) s WHERE {every})"

    a, b = part("a", "slug", "documents WHERE slug IS NOT NULL AND content IS NOT NULL"), part("b", "slug, anchor", "sections")
    return f"WITH {a}, {b} SELECT slug, NULL AS anchor, 'document' AS match_type, round(score, 6) AS score FROM a UNION ALL SELECT slug, anchor, 'section', round(score, 6) FROM b"


@register("doc_search", _bm25_sql(["envelope", "drawdown"]))
def doc_search(spark, sf_dir):
    hits = d.search(*_two(spark, sf_dir), "Envelope drawdown", expand=False, stem=False)
    return hits.select("slug", "anchor", "match_type", F.round("score", 6).alias("score"))


@register("doc_search_stemmed")
def doc_search_stemmed(spark, sf_dir):
    return d.search(*_two(spark, sf_dir), "smoothed envelopes")


@register("doc_by_tags", "SELECT slug FROM documents WHERE slug IS NOT NULL AND content IS NOT NULL AND (list_contains(list_transform(tags, lambda t: lower(t)), 'envelope') OR list_contains(list_transform(string_split(regexp_extract(content, '(?im)^Tags?:\\s*(.+)$', 1), ','), lambda t: regexp_replace(lower(trim(t, E' \\r\\t')), '[.;:]+$', '')), 'envelope'))")
def doc_by_tags(spark, sf_dir):
    return d.search(*_two(spark, sf_dir), "", tags=["envelope"]).select("slug")


@register("doc_glossary")
def doc_glossary(spark, sf_dir):
    return d.glossary_terms(*_two(spark, sf_dir))


_Q = "(SELECT first(vec ORDER BY vec_id) FROM vectors WHERE len(vec) = 64 AND vec_id = 7)"


@register(
    "retrieve_dense",
    f"""WITH q AS (SELECT list_transform({_Q}, lambda x: CAST(x AS DOUBLE)) AS q), v AS (SELECT id, list_transform(vec, lambda x: CAST(x AS DOUBLE)) AS v FROM vectors WHERE id IS NOT NULL AND len(vec) = 64),
s AS (SELECT id, max(list_inner_product(v, q) / sqrt(list_inner_product(v, v) * list_inner_product(q, q))) AS score FROM v, q WHERE list_inner_product(v, v) > 0 AND NOT isnan(list_inner_product(v, v)) GROUP BY id)
SELECT id, round(score, 6) AS score FROM s ORDER BY score DESC, id LIMIT 10""",
)
def retrieve_dense(spark, sf_dir):
    v = table(spark, sf_dir, "vectors")
    q = v.where("vec_id = 7 and size(vec) = 64").select("vec").first()["vec"]
    return r.dense_similar(v, q, 10).select("id", F.round("score", 6).alias("score"))


@register("retrieve_embeddings", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = (SELECT min(vec_id) FROM embeddings))
SELECT CAST(vec_id AS VARCHAR) AS id, round(list_inner_product(v, q) / sqrt(list_inner_product(v, v) * list_inner_product(q, q)), 6) AS score FROM e, q ORDER BY 2 DESC, 1 LIMIT 10""")
def retrieve_embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec"), "vec_id")
    return r.dense_similar(e, e.orderBy("vec_id").first()["vec"], 10).select("id", F.round("score", 6).alias("score"))


@register("retrieve_semantic")
def retrieve_semantic(spark, sf_dir):
    return r.build_semantic_index(r.weighted_documents(graph(spark, sf_dir).haystacks()), 128).similar("the bullish envelope filters the momentum", 10)


@register("retrieve_fused", "WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings WHERE vec_id < 60), b AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) AS r FROM embeddings WHERE vec_id < 60) SELECT CAST(vec_id AS VARCHAR) AS id, round(sum(1.0 / (5 + r)), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY vec_id")
def retrieve_fused(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").where("vec_id < 60").select(F.col("vec_id").cast("string").alias("id"), "vec_id")
    a = r.ranking(e.select("id", (-F.col("vec_id")).cast("double").alias("score")), "a")
    b = r.ranking(e.select("id", F.col("vec_id").cast("double").alias("score")), "b")
    return r.fuse_rankings(a, b).select("id", F.round("score", 8).alias("score"))


_RANKED = """AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT CAST(vec_id AS VARCHAR) AS id, max(list_inner_product(v, q) / sqrt(list_inner_product(v, v) * list_inner_product(q, q))) AS score
FROM e, (SELECT v AS q FROM e WHERE vec_id = (SELECT {}(vec_id) FROM embeddings)) GROUP BY vec_id) QUALIFY r <= 60)"""


@register("retrieve_fused_dense", f"WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), a {_RANKED.format('min')}, b {_RANKED.format('max')} SELECT id, round(sum(1.0 / (5 + r)), 8) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id")
def retrieve_fused_dense(spark, sf_dir):
    """The 60 nearest of all embeddings to each of two questions, fused."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec"), "vec_id")
    first, last = e.orderBy("vec_id").first()["vec"], e.orderBy(F.desc("vec_id")).first()["vec"]
    a, b = (r.ranking(r.dense_similar(e, q, 60), name) for q, name in ((first, "a"), (last, "b")))
    return r.fuse_rankings(a, b).select("id", F.round("score", 8).alias("score"))


@register("retrieve_chunks")
def retrieve_chunks(spark, sf_dir):
    g = graph(spark, sf_dir)
    return r.chunks_of(g.haystacks(), g.nodes.select("id", "summary"))
