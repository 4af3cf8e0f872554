"""Writers of the corpus's tables."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, stats


def news(df: DataFrame, path: str, order: str = "crawled_at") -> None:
    """Articles by category; of those with the same id in a category the last wins. Only written categories are replaced."""
    last = df.groupBy("category_slug", "source_id").agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")
    last.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("category_slug").json(path)


def attachments(df: DataFrame, path: str) -> None:
    """Attachment bytes by source; equal names of a source overwrite each other."""
    last = dedup.last_wins(df, ["source_id", "filename"], "seq")
    last.select("source_id", F.element_at(F.split("filename", "/"), -1).alias("file_name"), "content").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(path)


def snapshot(df: DataFrame, path: str) -> str:
    """A new version of a table beside the old ones.

    A version counts once its writer's marker of success is there, and the newest that counts is current:
    there is no pointer to overwrite, so readers see the old version or the new one, whole.
    """
    version = f"v-{time.time_ns():020d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    return version


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The current version of a table; empty if there is none."""
    marks = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v-*/_SUCCESS")
    found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks)
    versions = sorted(x.getPath().getParent().toString() for x in found or ())
    return spark.read.schema(schema).parquet(versions[-1]) if versions else spark.createDataFrame([], schema)


def documents(df: DataFrame, path: str) -> DataFrame:
    """The cleaned tier, replaced as a whole and laid out by kind, and its manifest, which is returned."""
    stamped = df.withColumn("cleaned_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    stamped.write.mode("overwrite").partitionBy("kind").json(f"{path}/documents")
    # from what was written: extraction and cleaning don't run again
    manifest = stats.manifest(df.sparkSession.read.schema("kind string, content string").json(f"{path}/documents"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def chunks(df: DataFrame, path: str, collection: str, clear: bool = False) -> None:
    """Adds chunks to a collection, or replaces it. Without ``clear``, chunks written again are there twice."""
    out = df.withColumns({"chunk_id": F.expr("uuid()"), "collection": F.lit(collection)})
    out.write.mode("overwrite" if clear else "append").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def download_log(df: DataFrame, path: str) -> None:
    """Records of downloads, whole and with counts by provider and status."""
    df.write.mode("overwrite").json(f"{path}/log")
    stats.status_counts(df, "provider", "status").write.mode("overwrite").json(f"{path}/stats")


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text, times in ISO form, nested records included."""
    return df.select(F.to_json(F.struct(*df.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}).alias("value"))
