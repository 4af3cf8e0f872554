"""Raw files as a stream: new JSON articles are cleaned and added once. An extension of the batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions import html as H
from ..operators.dedup import content_key


def articles(spark: SparkSession, path: str, watermark: str = "7 days") -> DataFrame:
    """A stream of cleaned articles; content seen within the watermark isn't repeated."""
    raw = spark.readStream.schema(schemas.RAW_NEWS).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    clean = H.clean_html(raw, "content_html", "content")
    timed = clean.withColumns({"checksum": content_key("content"), "seen_at": F.coalesce(F.try_to_timestamp("crawled_at"), F.current_timestamp())})
    return timed.where(F.length("content") > 0).withWatermark("seen_at", watermark).dropDuplicatesWithinWatermark(["checksum"]).select("source_id", "category", "title", "content", "checksum", "seen_at")


def counts(stream: DataFrame, window: str = "1 day", watermark: str = "7 days") -> DataFrame:
    """Articles by category and time window."""
    return stream.groupBy(F.window("seen_at", window), "category").agg(F.count("*").alias("n"))


def start(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the stream's articles to Parquet, all that are there now, exactly once."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
