"""Joins by which the crawl and the loaders look things up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_default(df: DataFrame, dimension: DataFrame, key: str, name: str, into: str, fallback: str = "type") -> DataFrame:
    """``df`` with a dimension's name for its key, else the key, else ``fallback``. Keys are compared as strings."""
    dim = dimension.select(F.col(key).cast("string").alias("__k"), F.col(name).alias("__n"))
    joined = df.join(dim, F.col(key).cast("string") == F.col("__k"), "left")
    return joined.withColumn(into, F.coalesce("__n", F.nullif(F.col(key).cast("string"), F.lit("")), F.lit(fallback))).drop("__k", "__n")


def unvisited(df: DataFrame, visited: DataFrame, key: str = "url_hash") -> DataFrame:
    return df.join(visited.select(key), key, "left_anti")


def already_visited(df: DataFrame, visited: DataFrame, key: str = "url_hash") -> DataFrame:
    return df.join(visited.select(key), key, "left_semi")


def insert_or_ignore(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows whose key it lacks, each key once; of new rows with equal keys the first by all columns."""
    fresh = rows.join(table.select(key), key, "left_anti").groupBy(key).agg(F.min(F.struct(*rows.columns)).alias("r")).select("r.*")
    return table.unionByName(fresh.select(*table.columns))


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def stored(index: DataFrame, listing: DataFrame, path: str = "local_path", found: str = "path") -> DataFrame:
    """Records whose file is in a listing."""
    return index.join(listing.select(F.col(found).alias("__p")).distinct(), F.col(path) == F.col("__p"), "left_semi")


def reuse_or_store(sightings: DataFrame, index: DataFrame, listing: DataFrame) -> DataFrame:
    """Each sighting with ``reused``: whether its bytes are indexed and the file still exists."""
    known = stored(index, listing).select(F.col("checksum").alias("__c")).distinct()
    return sightings.join(known, F.col("checksum") == F.col("__c"), "left").withColumn("reused", F.col("__c").isNotNull()).drop("__c")
