"""Deduplication that keeps order: first or last record of a key, ordered sets of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of rows with equal keys the one of least ``seq``; partial sums run before the shuffle."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), seq).alias("__r")).select("__r.*")


def last_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), seq).alias("__r")).select("__r.*")


def ordered_set(df: DataFrame, keys: list[str], value: str, seq: str, into: str) -> DataFrame:
    """Per key the distinct values in order of first appearance."""
    seen = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(seq).alias("__s"))
    return seen.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__s", value))), lambda x: x[value]).alias(into))


def distinct_in_array(items: str, key) -> Column:
    """Elements of an array column, given by name, whose key appears for the first time."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def attachment_index(sightings: DataFrame) -> DataFrame:
    """One record per checksum of sightings (checksum, seq, source_id, url, local_path, size_bytes, file_type).

    The first sighting gives path, size, type and source; sources and URLs are kept in order.
    """
    first = sightings.groupBy("checksum").agg(F.min_by(F.struct("local_path", "size_bytes", "file_type", "source_id"), "seq").alias("f"))
    urls = ordered_set(sightings, ["checksum"], "url", "seq", "urls")
    refs = ordered_set(sightings, ["checksum"], "source_id", "seq", "referenced_by")
    joined = first.join(urls, "checksum", "left").join(refs, "checksum", "left")
    none = F.array().cast("array<string>")
    return joined.select("checksum", "f.local_path", "f.size_bytes", "f.file_type", F.coalesce("urls", none).alias("urls"), F.coalesce("referenced_by", none).alias("referenced_by"), F.col("f.source_id").alias("first_source_id"))


def content_key(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def upsert_index(index: DataFrame, sightings: DataFrame) -> DataFrame:
    """An index after more sightings: known checksums gain sources and URLs, others get a record."""
    fresh = attachment_index(sightings)
    old = index.select(*(F.col(c).alias(f"o_{c}") for c in fresh.columns))
    both = fresh.join(old, F.col("checksum") == F.col("o_checksum"), "full_outer")
    first = lambda c: F.when(F.col("o_checksum").isNotNull(), F.col(f"o_{c}")).otherwise(F.col(c)).alias(c)
    none = F.array().cast("array<string>")
    union = lambda c: F.array_distinct(F.concat(F.coalesce(f"o_{c}", none), F.coalesce(c, none))).alias(c)
    return both.select(*(union(c) if c in ("urls", "referenced_by") else first(c) for c in fresh.columns))
