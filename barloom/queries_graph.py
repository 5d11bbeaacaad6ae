"""Queries over the nodes and edges tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import graph_store as gs
from barloom.operators.graph import BACKBONE, RELATIONS, Graph
from barloom.queries import register, table

_G = """
WITH RECURSIVE nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(name, ''), coalesce(summary, '')) AS rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1),
ee AS (SELECT src, dst, regexp_replace(regexp_replace(lower(relation), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS relation, min(why) AS why
  FROM edges WHERE relation IS NOT NULL AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) GROUP BY 1, 2, 3)
"""


def graph(spark, sf_dir) -> Graph:
    return Graph(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges"))


def _simple(name, sql, f):
    register(name, _G + sql)(lambda spark, sf_dir: f(graph(spark, sf_dir)))


_simple("graph_edges", "SELECT src, dst, relation, why FROM ee", lambda g: g.edges)
_simple("graph_stats", "SELECT 'primitive' AS what, primitive AS value, count(*) AS n FROM nn GROUP BY 2 UNION ALL SELECT 'relation', relation, count(*) FROM ee GROUP BY 2", lambda g: g.stats())
_simple("graph_roles", "SELECT DISTINCT dst AS id FROM ee WHERE relation = 'has-role'", lambda g: g.roles())
_simple("graph_classes", "SELECT DISTINCT src AS id FROM ee WHERE relation = 'kind-of' AND dst IN ('concept:technical-analysis', 'concept:alternative-data')", lambda g: g.classes())
_simple("graph_statuses", "SELECT DISTINCT status FROM nn WHERE status IS NOT NULL", lambda g: g.statuses())
_simple("graph_input_columns", "SELECT DISTINCT unnest(map_keys(inputs)) AS input FROM nn", lambda g: g.input_columns())
_simple("graph_params", "SELECT DISTINCT unnest(map_keys(params)) AS param FROM nn", lambda g: g.params())
_simple("graph_units", "SELECT DISTINCT units FROM (SELECT unnest(map_values(outputs)).units AS units FROM nn) WHERE units IS NOT NULL", lambda g: g.units())
_simple("graph_schema", "SELECT DISTINCT a.primitive AS subject, relation, b.primitive AS object FROM ee JOIN nn a ON a.id = src JOIN nn b ON b.id = dst", lambda g: g.schema())


def _reach(start: str, relations, upward: bool) -> str:
    a, b = ("src", "dst") if upward else ("dst", "src")
    rel = ", ".join(f"'{r}'" for r in relations)
    return f", r AS (SELECT '{start}' AS id UNION SELECT {b} FROM ee JOIN r ON {a} = r.id WHERE relation IN ({rel})) "


_DOWN = [r for r, (_, t) in RELATIONS.items() if t] + ["instance-of"]
_MOM, _ROLE = "concept:signal", "property:role-filter"
_simple("graph_descendants", _reach(_MOM, BACKBONE, False) + f"SELECT id FROM r WHERE id <> '{_MOM}'", lambda g: g.descendants(_MOM).select("id"))
_simple("graph_ancestors", _reach(_MOM, BACKBONE, True) + f"SELECT id FROM r WHERE id <> '{_MOM}'", lambda g: g.ancestors("Signal").select("id"))
_ABOUT = "SELECT DISTINCT id FROM (SELECT id FROM r UNION SELECT src FROM ee WHERE relation = 'about' AND dst IN (SELECT id FROM r)) WHERE id <> '{}'"
_simple("graph_under", _reach("concept:technical-analysis", _DOWN, False) + _ABOUT.format("concept:technical-analysis"), lambda g: g.under("concept:technical-analysis"))
_simple("graph_in_class", _reach(_MOM, BACKBONE, False) + _ABOUT.format(_MOM), lambda g: g.in_class(_MOM))
_simple("graph_bearers", f"SELECT src AS id FROM ee WHERE relation = 'has-role' AND dst = '{_ROLE}'", lambda g: g.bearers(_ROLE))
_simple(
    "graph_neighbors",
    f"SELECT x.direction, x.relation, x.id, primitive, x.why FROM (SELECT 'out' AS direction, relation, dst AS id, why FROM ee WHERE src = '{_MOM}' UNION ALL SELECT 'in', relation, src, why FROM ee WHERE dst = '{_MOM}') x JOIN nn ON nn.id = x.id WHERE relation IN ('instance-of', 'kind-of', 'part-of')",
    lambda g: g.neighbors(_MOM, category="structural"),
)
_simple("graph_get", f"SELECT 'out' AS direction, relation, count(*) AS n FROM ee WHERE src = '{_MOM}' GROUP BY 2 UNION ALL SELECT 'in', relation, count(*) FROM ee WHERE dst = '{_MOM}' GROUP BY 2", lambda g: g.get("Concept:Signal")[1])
_BALL = f", b AS (SELECT src AS id, dst AS nxt FROM ee UNION SELECT dst, src FROM ee), h1 AS (SELECT DISTINCT nxt AS id FROM b WHERE id = '{_MOM}'), ball AS (SELECT '{_MOM}' AS id UNION SELECT id FROM h1 UNION SELECT nxt FROM b JOIN h1 USING (id)) "
_simple("graph_subgraph", _BALL + "SELECT src, dst, relation FROM ee WHERE src IN (SELECT id FROM ball) AND dst IN (SELECT id FROM ball)", lambda g: g.subgraph(_MOM, 2)[1].select("src", "dst", "relation"))
_simple(
    "graph_outputs",
    "SELECT id, output, units, lo, hi FROM (SELECT id, unnest(map_keys(outputs)) AS output, unnest(map_values(outputs), max_depth := 1) AS o FROM nn) t, LATERAL (SELECT o.units AS units, o.lo AS lo, o.hi AS hi) WHERE lo IS NOT NULL AND hi IS NOT NULL AND isfinite(lo) AND isfinite(hi)",
    lambda g: g.outputs(bounded=True).select("id", "output", "units", "lo", "hi"),
)


def _find_sql(terms: list[list[str]]) -> str:
    """``terms``: the spellings of each term of the question, written out."""
    any_of = lambda band, t: "(" + " OR ".join(f"contains({band}, '{v}')" for v in t) + ")"
    p = lambda k: f"coalesce(props['{k}'], '')"
    ranked = ["abbreviation", "formula", "reference", "interpretation", "applications", "explanation", "principles", "practices", "examples", "friendly_name", "short_description"]
    authored = " || ' ' || ".join([*map(p, ranked[1:9]), "array_to_string(map_keys(inputs), ' ')", "array_to_string(map_values(inputs), ' ')", "array_to_string(map_keys(params), ' ')", "array_to_string(map_keys(outputs), ' ')", "coalesce(array_to_string(list_transform(map_values(outputs), lambda o: concat_ws(' ', o.otype, o.units, o.canonical_name, o.description)), ' '), '')"])
    rest = f"coalesce(array_to_string(list_transform(list_filter(map_entries(props), lambda e: e.key NOT IN ({', '.join(repr(r) for r in ranked)})), lambda e: e.value), ' '), '')"
    bands = ["concat_ws(' ', name, id)", p("abbreviation"), "coalesce(summary, '')", authored, f"concat_ws(' ', primitive, status, epistemic, {rest}, reasons)"]
    hay = ", ".join(f"regexp_replace(lower({b}), 'https?://\\S+|www\\.\\S+', ' ', 'g') AS t{i}" for i, b in enumerate(bands))
    hits = ", ".join("CASE " + " ".join(f"WHEN {any_of(f't{i}', t)} THEN {i}" for i in range(5)) + f" END AS h{k}" for k, t in enumerate(terms))
    flags = ", ".join(f"(SELECT count(h{k}) <= 0.4 * count(*) FROM hits) AS r{k}" for k in range(len(terms)))
    all_rare = " OR ".join(f"r{k}" for k in range(len(terms)))
    use = [f"CASE WHEN r{k} OR NOT ({all_rare}) THEN h{k} END" for k in range(len(terms))]
    used = " + ".join(f"CASE WHEN r{k} OR NOT ({all_rare}) THEN 1 ELSE 0 END" for k in range(len(terms)))
    have = " + ".join(f"CASE WHEN ({u}) IS NOT NULL THEN 1 ELSE 0 END" for u in use)
    said = "SELECT src, string_agg(why, ' ' ORDER BY dst, relation) AS reasons FROM ee WHERE why <> '' GROUP BY 1"
    return f", said AS ({said}), hay AS (SELECT id, name, {hay} FROM nn LEFT JOIN said ON said.src = nn.id), hits AS (SELECT id, name, {hits} FROM hay), c AS (SELECT {flags}), s AS (SELECT id, name, {have} AS have, {used} AS used, greatest({', '.join(use)}, -1) AS tier FROM hits, c) SELECT id, name, CAST(used - have AS INT) AS missing, tier FROM s WHERE have > 0 AND have = (SELECT max(have) FROM s)"


for _k, _q, _t in (
    ("graph_find", "the bullish envelopes", [["bullish", "bullishs", "bullishes"], ["envelopes", "envelop", "envelope"]]),
    ("graph_find_partial", "order flow zzzz indicator", [["order", "orders", "orderes"], ["flow", "flows", "flowes"], ["zzzz", "zzzzs", "zzzzes"], ["indicator", "indicators", "indicatores"]]),
):
    _simple(_k, _find_sql(_t), lambda g, q=_q: g.find(q))


@register("graph_path", _G + f", b AS (SELECT src AS id, dst AS nxt FROM ee UNION SELECT dst, src FROM ee), w AS (SELECT '{_MOM}' AS id, ['{_MOM}'] AS way UNION ALL SELECT nxt, list_append(way, nxt) FROM w JOIN b USING (id) WHERE NOT list_contains(way, nxt) AND len(way) < 4) SELECT CAST(min(len(way)) - 1 AS INT) AS n_links FROM w WHERE id = 'property:role-filter'")
def graph_path(spark, sf_dir):
    way = graph(spark, sf_dir).materialise().path(_MOM, "property:role-filter")
    return spark.createDataFrame([(len(way) - 1 if way else None,)], "n_links int")


@register(
    "graph_all_paths",
    _G + f""", b AS (SELECT src AS id, dst AS nxt, true AS fwd FROM ee UNION SELECT dst, src, false FROM ee),
w AS (SELECT '{_MOM}' AS id, ['{_MOM}'] AS way, false AS arrow_in UNION
  SELECT nxt, list_append(way, nxt), fwd FROM w JOIN b USING (id) WHERE NOT list_contains(way, nxt) AND len(way) < 4 AND id <> 'property:role-filter' AND (fwd OR NOT arrow_in))
SELECT DISTINCT array_to_string(way, ' > ') AS way, CAST(len(way) - 1 AS INT) AS hops FROM w WHERE id = 'property:role-filter'""",
)
def graph_all_paths(spark, sf_dir):
    return graph(spark, sf_dir).materialise().all_paths(_MOM, "property:role-filter", 3).items.select(F.array_join("way", " > ").alias("way"), "hops")


@register("graph_ask")
def graph_ask(spark, sf_dir):
    """Seeds from search, the semantic index and the vectors near a given one of the same index."""
    g, question = graph(spark, sf_dir).materialise(haystacks=True), "which bullish envelope filters the momentum"
    v = table(spark, sf_dir, "vectors")
    given = v.where("vec_id = 7 and size(vec) = 64").first()
    near = g.dense_ranking(v.where(F.col("index_name") == given["index_name"]), given["vec"])
    return g.ask(question, g.semantic_ranking(question).unionByName(near), hops=1)


# the store

_simple("store_orphans", "SELECT id FROM nn WHERE id NOT IN (SELECT src FROM ee UNION SELECT dst FROM ee)", lambda g: gs.orphans(g.nodes, g.edges))
_simple(
    "store_disconnected",
    ", b AS (SELECT src AS id, dst AS nxt FROM ee UNION SELECT dst, src FROM ee), r AS (SELECT 'concept:signal' AS id UNION SELECT nxt FROM b JOIN r USING (id)) SELECT id FROM nn WHERE id NOT IN (SELECT id FROM r)",
    lambda g: (g.materialise(), gs.disconnected(g.nodes, g.edges, g.nodes.where("id = 'concept:signal'")))[1],
)
_simple("store_traverse", _reach(_MOM, ["kind-of", "instance-of", "part-of"], True) + "SELECT id FROM r", lambda g: gs.reachable(g.edges, g.nodes.where(F.col("id") == _MOM), ["kind-of", "instance-of", "part-of"]).select("id"))
_simple("store_impact", _reach(_MOM, RELATIONS, False) + f"SELECT id FROM r WHERE id <> '{_MOM}'", lambda g: gs.impact(g.materialise().edges, _MOM).select("id"))
_simple("store_counts", "SELECT 'primitive' AS what, primitive AS value, count(*) AS n FROM nn GROUP BY 2 UNION ALL SELECT 'relation', relation, count(*) FROM ee GROUP BY 2", lambda g: gs.counts(g.nodes, g.edges))
_simple(
    "store_coverage", "SELECT 'primitive' AS what, 5 AS declared, count(DISTINCT primitive) AS used, count(DISTINCT primitive) / 5 AS share FROM nn UNION ALL SELECT 'relation', 7, count(DISTINCT relation), count(DISTINCT relation) / 7 FROM ee",
    lambda g: gs.coverage(g.nodes, g.edges, ["Concept", "Procedure", "Module", "Property", "Principle"], list(RELATIONS)),
)


@register("store_diff", _G + "SELECT coalesce(a.id, b.id) AS entity, CASE WHEN a.id IS NULL THEN 'generated' WHEN b.id IS NULL THEN 'invalidated' ELSE 'revised' END AS change FROM (SELECT id, summary FROM nn WHERE created_at < TIMESTAMPTZ '2024-06-01') a FULL JOIN (SELECT id, CASE WHEN status = 'draft' THEN upper(summary) ELSE summary END AS summary FROM nn WHERE primitive <> 'Module') b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.summary IS DISTINCT FROM b.summary")
def store_diff(spark, sf_dir):
    n = graph(spark, sf_dir).nodes
    a = n.where("created_at < timestamp'2024-06-01 00:00:00'").select("id", "summary")
    b = n.where("primitive <> 'Module'").select("id", F.when(F.col("status") == "draft", F.upper("summary")).otherwise(F.col("summary")).alias("summary"))
    return gs.diff(gs.snapshot(a, ["id"]), gs.snapshot(b, ["id"]))


_SEEDED = "CASE WHEN primitive = 'Concept' THEN 2 WHEN status = 'draft' THEN NULL ELSE 1 END"


@register("store_sweep", _G + f"SELECT id, CASE WHEN primitive = 'Concept' OR status = 'draft' THEN status ELSE 'deprecated' END AS status FROM nn")
def store_sweep(spark, sf_dir):
    """Reseed 2 wrote the concepts again; drafts were proposed at run time."""
    g = graph(spark, sf_dir)
    return gs.sweep(g.nodes.withColumn("reseed_seq", F.expr(_SEEDED)), g.edges.withColumn("reseed_seq", F.lit(2)), 2)[0].select("id", "status")


_simple("store_knowledge_nodes", "SELECT id, name FROM nn WHERE primitive IS NOT NULL AND status = 'draft'", lambda g: gs.knowledge_nodes(g.nodes, "draft").select("id", "name"))
_simple("store_nodes_by_primitive", "SELECT id, name FROM nn WHERE primitive = 'Principle'", lambda g: gs.nodes_by_primitive(g.nodes, "Principle").select("id", "name"))
_PARENTS = [("kind-of", "structural"), ("part-of", "structural"), ("instance-of", "structural"), ("structural", "associated-with"), ("uses", "associative"), ("associative", "associated-with")]
_simple(
    "store_edges_by_relation", "SELECT src, dst, relation FROM ee WHERE relation IN ('kind-of', 'part-of', 'instance-of')",
    lambda g: gs.edges_by_relation(g.edges, "structural", g.spark.createDataFrame(_PARENTS, "relation string, parent string")).select("src", "dst", "relation"),
)
_simple(
    "store_resolve", "SELECT id FROM (SELECT DISTINCT id FROM nn WHERE contains(lower(id), 'envelope') OR contains(lower(name), 'envelope') ORDER BY length(id), id LIMIT 12)",
    lambda g: g.spark.createDataFrame([(i,) for i in gs.resolve(g.nodes, "envelope")], "id string"),
)
_simple(
    "store_circles",
    """, e AS (SELECT DISTINCT relation, src, dst FROM ee WHERE relation IN ('kind-of', 'part-of', 'supersedes')),
t AS (SELECT relation, src AS start, dst AS fin FROM e UNION SELECT t.relation, t.start, e.dst FROM t JOIN e ON e.relation = t.relation AND e.src = t.fin),
ring AS (SELECT DISTINCT relation, start AS id FROM t WHERE start = fin)
SELECT relation, src, dst FROM e WHERE EXISTS (SELECT 1 FROM ring r WHERE r.relation = e.relation AND (r.id = e.src OR EXISTS (SELECT 1 FROM t WHERE t.relation = e.relation AND t.start = r.id AND t.fin = e.src)))
  AND EXISTS (SELECT 1 FROM ring r WHERE r.relation = e.relation AND (r.id = e.dst OR EXISTS (SELECT 1 FROM t WHERE t.relation = e.relation AND t.start = e.dst AND t.fin = r.id)))""",
    lambda g: gs.circles(g.edges),
)
