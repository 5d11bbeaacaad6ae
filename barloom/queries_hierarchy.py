"""Queries over parent-child links."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators.hierarchy import descendants, hierarchy, parent_links
from barloom.queries import register, table

RELATIONS = ["kind-of", "part-of"]

_WALK = """
WITH RECURSIVE named AS (
  SELECT DISTINCT regexp_replace(regexp_replace(lower(relation), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS relation, src, dst
  FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)),
links AS (SELECT relation, src, min(dst) AS dst FROM named WHERE relation IN ('kind-of', 'part-of') GROUP BY 1, 2),
members AS (SELECT relation, src AS node FROM links UNION SELECT relation, dst FROM links),
walk AS (
  SELECT relation, node, node AS at, [node] AS way FROM members
  UNION ALL
  SELECT w.relation, w.node, l.dst, list_append(w.way, l.dst)
  FROM walk w JOIN links l ON l.relation = w.relation AND l.src = w.at WHERE NOT list_contains(w.way, l.dst)),
far AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY relation, node ORDER BY len(way) DESC) = 1),
solved AS (
  SELECT f.relation, f.node, f.way, l.dst IS NOT NULL AS circle,
    CASE WHEN l.dst IS NULL THEN f.at ELSE list_min(f.way[list_position(f.way, l.dst):]) END AS root
  FROM far f LEFT JOIN links l ON l.relation = f.relation AND l.src = f.at)
"""


def _resolved(spark, sf_dir, with_paths):
    return hierarchy(parent_links(table(spark, sf_dir, "edges"), table(spark, sf_dir, "nodes"), RELATIONS), with_paths=with_paths)


@register("p3_found", _WALK + "SELECT relation, node AS node_id, root AS root_id, CAST(CASE WHEN circle THEN -1 ELSE len(way) - 1 END AS BIGINT) AS n_links FROM solved")
def p3_found(spark, sf_dir):
    return _resolved(spark, sf_dir, False).select(F.col("tree").alias("relation"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), F.col("depth").alias("n_links"))


@register("p3_paths", _WALK + "SELECT relation, node AS node_id, CAST(len(way) - 1 AS BIGINT) AS depth, array_to_string(list_reverse(way), ' > ') AS path FROM solved WHERE NOT circle")
def p3_paths(spark, sf_dir):
    done = _resolved(spark, sf_dir, True).where("depth >= 0")
    return done.select(F.col("tree").alias("relation"), F.col("node").alias("node_id"), "depth", F.array_join("path", " > ").alias("path"))


@register(
    "p3_descendants",
    _WALK + ", pairs AS (SELECT relation, unnest(way[2:]) AS ancestor_id, unnest(range(1, len(way))) AS distance FROM solved WHERE NOT circle) "
    "SELECT relation, ancestor_id, count(*) AS n_descendants, CAST(max(distance) AS BIGINT) AS height FROM pairs GROUP BY 1, 2",
)
def p3_descendants(spark, sf_dir):
    pairs = descendants(_resolved(spark, sf_dir, True))
    return pairs.groupBy(F.col("tree").alias("relation"), F.col("ancestor").alias("ancestor_id")).agg(F.count("*").alias("n_descendants"), F.max("distance").alias("height"))
