"""How distinctive a term is for a record: log-entropy weights from two aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.plans.skew import spread_lookup
from barloom.plans.storage import write_table

#: Words that are no terms.
FUNCTION_WORDS = (
    "an as at be been by can do for from had has have if in into is it its may must no not of on or so such than that the their them "
    "then there these they this those through to too was were what when where which while who why will with within would and but"
).split()


def log_entropy(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, term, tf, df, gf, weight)`` for each term of each record.

    Terms are the maximal runs of a-z and 0-9, two or more long, of the lower-cased text,
    without function words.  weight = ln(1 + tf) * (1 - H / ln n), where H is the entropy of
    the term's spread over records and n the number of records that hold a term: a term of one
    record weighs ln(1 + tf), one spread evenly over all of them nothing; with n = 1 there is no
    spread and H / ln n counts as 0.  Repeated rows count once; several texts of one key count
    as one record; null keys and records without terms give no rows.

    The first aggregation counts terms per record in the partitioning that removes repeats and is
    written once; the second sums them per term with map-side partial sums, so a term of every record is no hot key,
    and the weights are joined back in spread buckets.
    """
    records = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).groupBy(key).agg(F.collect_set(text).alias("texts"))
    words = F.flatten(F.transform("texts", lambda t: F.regexp_extract_all(F.lower(t), F.lit("([a-z0-9]{2,})"), F.lit(1))))
    counts = records.select(key, F.explode(words).alias("term")).where(~F.col("term").isin(FUNCTION_WORDS)).groupBy(key, "term").agg(F.count("*").alias("tf"))
    counts = write_table(counts, "terms")
    spread = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("gf"), F.sum(F.col("tf") * F.ln("tf")).alias("tlt"))
    n = counts.select(key).distinct().agg(F.count("*").alias("n")).scalar()
    entropy = F.when(n > 1, (F.ln("gf") - F.col("tlt") / F.col("gf")) / F.ln(n)).otherwise(0.0)
    stats = spread.select("term", "df", "gf", F.greatest(1 - entropy, F.lit(0.0)).alias("global_weight"))  # rounding may fall below 0
    joined = spread_lookup(counts, stats, ["term"], F.col(key))
    return joined.select(key, "term", "tf", "df", "gf", (F.ln(1 + F.col("tf")) * F.col("global_weight")).alias("weight"))
