"""Retrieval metrics. An extension: the original names them in its configuration only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(hits: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """Mean recall, reciprocal rank and nDCG at ``k`` of hits (query, rank, rel, total relevant)."""
    top = hits.where(F.col("rank") <= k)
    gain = F.when(F.col("rel"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("total")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    per = top.groupBy(query).agg(
        F.sum(F.when(F.col("rel"), 1.0).otherwise(0.0)).alias("found"), F.max("total").alias("total"), F.max(F.when(F.col("rel"), 1 / F.col("rank")).otherwise(0.0)).alias("rr"), F.sum(gain).alias("dcg"),
    )
    per = per.select((F.col("found") / F.col("total")).alias("recall"), "rr", (F.col("dcg") / ideal).alias("ndcg"))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return per.agg(F.count("*").alias("questions"), mean("recall", "recall"), mean("rr", "mrr"), mean("ndcg", "ndcg"))
