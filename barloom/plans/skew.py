"""Joins that stay even when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread_lookup(left: DataFrame, right: DataFrame, keys: list[str], salt: Column, how: str = "inner", buckets: int = 64) -> DataFrame:
    """Join ``left`` with ``right`` (at most one row per key) without a hot task.

    Each (key, salt bucket) asks once: the distinct requests are joined with ``right``
    on the key (at most ``buckets`` requests a key), and the answers are joined back on
    (key, bucket), so the rows of one hot key lie in ``buckets`` tasks.  Rows with a null
    key find nothing; ``how`` is inner, left or left_semi.
    """
    bucket = "__bucket"
    salted = left.withColumn(bucket, F.pmod(F.xxhash64(salt), F.lit(buckets)).cast("int"))
    asked = salted.select(*keys, bucket).dropna(subset=keys).distinct()
    answers = asked.join(right, keys, "inner")
    if how == "left_semi":
        answers = answers.select(*keys, bucket)
    return salted.join(answers, [*keys, bucket], how).drop(bucket)
