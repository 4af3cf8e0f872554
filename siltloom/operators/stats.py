"""Counts and length statistics of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def length_stats(df: DataFrame, text: str, *by: str, empty: bool = True) -> DataFrame:
    """n, min_len, max_len, avg_len (whole number) and total_len of a text column; without ``empty``, of texts that aren't empty or null.

    Empty texts are left out within the sums: a filter would be evaluated below the steps that compute the text.
    """
    n = F.length(text).cast("bigint")
    count = F.count("*")
    if not empty:
        n = F.nullif(n, F.lit(0).cast("bigint"))
        count = F.count(n)
    out = df.groupBy(*by).agg(count.alias("n"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.sum(n).alias("total_len"))
    out = out if empty else out.where("n > 0")
    return out.withColumn("avg_len", F.expr("total_len div n"))


def manifest(docs: DataFrame) -> DataFrame:
    """Documents and characters by kind, and in total (kind null)."""
    return docs.groupingSets([["kind"], []], "kind").agg(F.count("*").alias("documents"), F.sum(F.length("content").cast("bigint")).alias("chars"))


def manifest_documents(docs: DataFrame) -> DataFrame:
    """The manifest's list: id, kind, title, category, chars and file of each document."""
    return docs.select("doc_id", "kind", "title", "category", F.length("content").cast("bigint").alias("chars"), F.concat(F.col("kind"), F.lit("/"), F.col("doc_id"), F.lit(".json")).alias("file"))


def status_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def crawl_stats(visits: DataFrame) -> DataFrame:
    """Counters by type of visits (type_id, kind, ok, new_links, skipped)."""
    some = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    done: Column = ~F.col("skipped")
    return visits.groupBy("type_id").agg(
        some(done).alias("processed"), some(F.col("skipped")).alias("skipped"), some(done & (F.col("kind") == "list")).alias("list_pages"),
        some(done & (F.col("kind") == "detail")).alias("detail_pages"), F.sum("new_links").cast("bigint").alias("new_links"),
    )
