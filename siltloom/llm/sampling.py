"""A bounded, repeatable choice of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE = 1 << 40


def smallest_hashes(df: DataFrame, by: Column, n: int, *ties: str) -> DataFrame:
    """``df``'s rows of smallest hash of ``by``, at most ``n``, equal hashes in the order of ``ties``.

    A first cut on the hash, made from a count, leaves about twice n rows for the final sort, however
    many tasks there are.
    """
    hashed = df.withColumn("__h", F.pmod(F.xxhash64(by, F.lit("sample")), F.lit(RANGE)))
    total = df.count()
    if total > 2 * n:
        hashed = hashed.where(F.col("__h") < int(RANGE * 2 * n / total))
    return hashed.orderBy("__h", *ties).limit(n).drop("__h")
