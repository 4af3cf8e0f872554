"""Downloads of linked files, with a log row for every link."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from .adapters import Fetch

LEAST_BYTES = 1000
TITLE_CHARS = 60


def plan(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Links (provider, url, source_id, category, title) with a file name and whether such a file is there already.

    A drive link is fetched by its file id; one without an id is fetched as it is. ``listing``: file_name, length.
    """
    n = F.abs(F.xxhash64("url")) % 1_000_000
    named = manifest.withColumn("file", U.safe_filename(F.col("url"), F.coalesce("source_id", F.lit("")), n))
    there = listing.where(F.col("length") > LEAST_BYTES).select(F.col("file_name").alias("__f")).distinct()
    return named.join(there, F.col("file") == F.col("__f"), "left").withColumn("skipped", F.col("__f").isNotNull()).withColumn("file_id", U.drive_file_id(F.col("url"))).drop("__f")


def download(planned: DataFrame, fetch: Fetch) -> DataFrame:
    """The log (provider, url, status, file, reason, size, source_id, category, title) and the bytes of new files in ``content``.

    Replies that are too short, or a web page instead of a file, have failed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    status, body = (0, None) if row["skipped"] else fetch(row["url"])
                    out.append({"url": row["url"], "http": status, "content": body, "error": None})
                except Exception as e:  # noqa: BLE001  recorded with the link
                    out.append({"url": row["url"], "http": None, "content": None, "error": str(e)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("url", pa.string()), ("http", pa.int32()), ("content", pa.binary()), ("error", pa.string())])
    got = planned.select("url", "skipped").mapInArrow(run, "url string, http int, content binary, error string")
    got = got.select(F.col("url").alias("__u"), "http", F.col("content").alias("body"), "error")
    bad = F.coalesce(U.is_html_reply(F.col("body"), LEAST_BYTES), F.lit(True))
    failed = F.col("error").isNotNull() | (F.col("http") >= 400) | bad
    status = F.when(F.col("skipped"), "skipped").when(failed, "failed").otherwise("ok")
    reason = F.when(F.col("skipped") | ~failed, None).when(F.col("error").isNotNull(), F.col("error")).when(F.col("http") >= 400, F.concat(F.lit("HTTP "), F.col("http").cast("string"))).otherwise("not a file")
    joined = planned.join(got, F.col("url") == F.col("__u")).withColumn("status", status).withColumn("reason", F.substring(reason, 1, 200))
    kept = F.when(F.col("status") == "ok", F.col("body"))
    return joined.select("provider", "url", "status", "file", "reason", F.length(kept).cast("bigint").alias("size"), "source_id", "category", F.substring("title", 1, TITLE_CHARS).alias("title"), kept.alias("content"))
