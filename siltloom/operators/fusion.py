"""Weighted fusion of vector and keyword hits, and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fuse(vector: DataFrame, keyword: DataFrame, vector_weight: float = 0.65, keyword_weight: float = 0.35, k: int = 10, query: str = "query_id", text: str = "text") -> DataFrame:
    """query, text, doc (struct of a representative's columns), score and rank of the k best texts.

    Both inputs have query, rank (from 1), score, text and like columns beside. Hits of equal text are one:
    scores add up, the raw similarity for vectors and 1 - place / hits for keywords. It is represented
    by its last vector hit, else its first keyword hit; ties, to nine places, go to what was seen first.
    """
    beside = [c for c in vector.columns if c in keyword.columns and c not in (query, "rank", "score", text)]
    n = keyword.groupBy(query).agg(F.count("*").alias("__n"))
    v = vector.select(query, text, (F.lit(vector_weight) * F.col("score")).alias("part"), F.lit(0).alias("side"), F.col("rank").cast("bigint").alias("seq"), *beside)
    place = F.lit(1.0) - (F.col("rank") - 1) / F.col("__n")
    w = keyword.join(n, query).select(query, text, (F.lit(keyword_weight) * place).alias("part"), F.lit(1).alias("side"), F.col("rank").cast("bigint").alias("seq"), *beside)
    both = v.unionByName(w)
    doc = F.struct(*beside) if beside else F.struct(F.lit(None).cast("string").alias("none"))
    choice = F.struct((-F.col("side")).alias("a"), F.when(F.col("side") == 0, F.col("seq")).otherwise(-F.col("seq")).alias("b"))
    summed = both.groupBy(query, text).agg(F.sum("part").alias("score"), F.max_by(doc, choice).alias("doc"), F.min(F.struct("side", "seq")).alias("first"))
    best = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), "first")
    return summed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("first")


def rerank(hits: DataFrame, score: Column, candidates: int = 20, top: int = 6, query: str = "query_id") -> DataFrame:
    """The ``top`` of the first ``candidates`` hits by a new score, ties in the order they came."""
    best = Window.partitionBy(query).orderBy(F.desc("rerank_score"), "rank")
    scored = hits.where(F.col("rank") <= candidates).withColumn("rerank_score", score)
    return scored.withColumn("__new", F.row_number().over(best)).where(F.col("__new") <= top).withColumn("rank", F.col("__new")).drop("__new")
