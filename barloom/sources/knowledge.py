"""Knowledge records: JSON graphs, Markdown folders, and wiki pages merged into nodes and edges."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.documents import _udf, slugify

_ATOMS = "array<struct<id:string,title:string,kind:string,summary:string,epistemic:string,status:string,props:map<string,string>>>"
_LINKS = "array<struct<from:string,rel:string,to:string,why:string>>"


def graph_path(explicit: str | None = None, default: str | None = None) -> str:
    """Where the graph record is: the given path, else ``BARLOOM_GRAPH``, else the default."""
    path = explicit or os.environ.get("BARLOOM_GRAPH") or default
    if not path:
        raise FileNotFoundError("no graph record is configured")
    return path


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``id, name, primitive, summary, status, epistemic, props`` and edges ``src, dst, relation, why`` of a record {atoms, relations}.

    Rows without an id or an end are kept as nulls for the graph to drop; leftover properties are
    JSON-encoded by the reader into strings.
    """
    doc = spark.read.schema(f"atoms {_ATOMS}, relations {_LINKS}").option("multiLine", True).json(path)
    atom = doc.select(F.explode("atoms").alias("a")).select("a.*")
    nodes = atom.select("id", F.col("title").alias("name"), F.col("kind").alias("primitive"), "summary", "status", "epistemic", "props")
    link = doc.select(F.explode("relations").alias("r")).select("r.*")
    return nodes, link.select(F.col("from").alias("src"), F.col("to").alias("dst"), F.col("rel").alias("relation"), "why")


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The same two frames as JSON lines, one folder each, written in parallel."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def read_chapters(spark: SparkSession, path: str, *, max_chars: int = 1_000_000) -> DataFrame:
    """``slug, number, title, content, importance, sha`` of Markdown files named ``NN-name.md``; others and oversized ones are left out.

    The slug is the number and the name, the title the first heading of level 1 without its number,
    importance 100 less the number.
    """
    files = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("content"))
    number = F.expr("try_cast(regexp_extract(file, '^(\\\\d+)-', 1) AS INT)")
    rest = F.regexp_replace(F.regexp_extract("file", r"^\d+-(.+)\.md$", 1), "%20", " ")
    slug = F.concat_ws("-", number.cast("string"), F.regexp_replace(F.regexp_replace(F.lower(rest), r"[\s_]+", "-"), r"[^a-z0-9-]", ""))
    title = F.regexp_replace(F.regexp_extract("content", r"(?m)^#\s+(.+?)\s*$", 1), r"^\d+\.\s*", "")
    rows = files.where(number.isNotNull() & (F.length("content") <= max_chars))
    return rows.select(slug.alias("slug"), number.alias("number"), title.alias("title"), "content", (F.lit(100) - number).alias("importance"), F.sha2("content", 256).alias("sha"))


def merge_pages(pages: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wiki pages ``title, kind, summary`` and links ``src_title, relation, dst_title, why`` to nodes and edges.

    Ids are ``kind:slug``.  A link without a reason, to an unknown page, or told twice raises.
    """
    slug = _udf(slugify, T.StringType())
    nodes = pages.where("title is not null").select(F.concat(F.lower("kind"), F.lit(":"), slug("title")).alias("id"), F.col("title").alias("name"), F.col("kind").alias("primitive"), "summary").distinct()
    by_name = nodes.select("name", "id")
    e = links.join(by_name.selectExpr("name as src_title", "id as src"), "src_title", "left").join(by_name.selectExpr("name as dst_title", "id as dst"), "dst_title", "left")
    bad = e.agg(
        F.sum((F.coalesce(F.trim("why"), F.lit("")) == "").cast("int")).alias("without a reason"), F.sum((F.col("src").isNull() | F.col("dst").isNull()).cast("int")).alias("to an unknown page"),
        (F.count("*") - F.count_distinct("src_title", "relation", "dst_title")).alias("told twice"),
    ).first()
    for what in ("without a reason", "to an unknown page", "told twice"):
        if bad[what]:
            raise ValueError(f"{bad[what]} links are {what}")
    return nodes, e.select("src", "dst", "relation", "why")


#: Sections of an authored computation; the first four must be there.
AUTHORED = ("Formula", "Inputs", "Outputs", "Warmup", "Params", "Reference", "Interpretation", "Applications", "Abbreviation")


def parse_authored(doc: str) -> dict[str, str]:
    """The sections of a computation's description, strictly: unknown, repeated, empty or missing sections raise."""
    out: dict[str, list[str]] = {}
    at = None
    for line in (doc or "").splitlines():
        m = re.match(r"^[ \t]*([A-Z][A-Za-z-]+):[ \t]*(.*)$", line)
        if m and m[1] in AUTHORED:
            if m[1] in out:
                raise ValueError(f"section {m[1]} comes twice")
            at = m[1]
            out[at] = [m[2].strip()] if m[2].strip() else []
        elif m and at is None:
            raise ValueError(f"unknown section {m[1]}")
        elif at and line.strip():
            out[at].append(line.strip())
    missing = [s for s in AUTHORED[:4] if not out.get(s)]
    if missing:
        raise ValueError(f"missing sections {missing}")
    return {k: "\n".join(v) for k, v in out.items()}


def bounded_json(rows: list[dict], most_bytes: int = 24_000) -> tuple[str, bool]:
    """A JSON list within a byte budget: rows are dropped from the end by halves until it fits; whether any was."""
    kept = rows
    while True:
        text = json.dumps(kept, ensure_ascii=False, default=str)
        if len(text.encode()) <= most_bytes or not kept:
            return text, len(kept) < len(rows)
        kept = kept[: len(kept) // 2]
