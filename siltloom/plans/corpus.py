"""The offline jobs: raw sources to cleaned documents, documents to an index of chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.chunk import explode_chunks
from ..operators import stats
from ..session import cut, ship
from ..sources import adapters, readers, sinks
from ..sources.extract import extract_udf

COLUMNS = ("doc_id", "kind", "title", "content", "source_url", "category", "source_id", "referenced_by", "metadata")


def union_documents(*sources: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [s.select(*COLUMNS) for s in sources])


def build_corpus(spark: SparkSession, root: str, out: str, config: Config | None = None, limit: int | None = None, zero_width: str = "parity") -> DataFrame:
    """Cleans news, attachments and external files below ``root`` and writes the cleaned tier; returns its manifest."""
    ship(spark)
    config = config or Config()
    extract = extract_udf(config.crawl.extraction_timeout)
    found = [readers.news(spark, f"{root}/news", zero_width, limit)]
    exists = lambda p: (q := spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(q)
    if exists(f"{root}/attachments_index.json"):
        found.append(readers.attachments(readers.attachment_index(spark, f"{root}/attachments_index.json"), readers.files(spark, f"{root}/attachments"), extract_udf(), zero_width))
    if exists(f"{root}/external_files/download_log.json"):
        found.append(readers.external(readers.download_log(spark, f"{root}/external_files/download_log.json"), readers.files(spark, f"{root}/external_files"), extract, zero_width=zero_width))
    return sinks.documents(union_documents(*found), out)


def chunk_documents(docs: DataFrame, config: Config | None = None) -> DataFrame:
    """chunk and meta of every document; a source only where the document has one."""
    c = (config or Config()).chunking
    chunks = explode_chunks(docs.select(*(x for x in COLUMNS if x != "metadata")), "content", c.chunk_size, c.chunk_overlap)
    meta = F.struct("doc_id", "kind", "title", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("source_id", F.lit("")).alias("source_id"), F.coalesce("referenced_by", F.array().cast("array<string>")).alias("referenced_by"), F.nullif("source_url", F.lit("")).alias("source"))
    return chunks.select(F.col("chunk").alias("text"), "chunk_pos", meta.alias("meta"))


def build_index(docs: DataFrame, path: str, collection: str, embedder: adapters.Embedder, config: Config | None = None, clear: bool = False, dry_run: bool = False, limit: int | None = None) -> DataFrame:
    """Chunks, embeds and stores documents; returns chunk statistics. ``dry_run`` only returns them."""
    ship(docs.sparkSession)
    config = config or Config()
    chunks = chunk_documents(docs.limit(limit) if limit else docs, config)
    if not dry_run:
        chunks = cut(chunks)  # chunked once, for the collection and for the statistics
        sinks.chunks(adapters.embed(chunks, "text", embedder, batch=config.embedding.batch_size), path, collection, clear)
    return stats.length_stats(chunks, "text")


def status(spark: SparkSession, path: str) -> DataFrame:
    """One row: status ('ok', or 'degraded' if the index can't be read) and chunks of all collections."""
    try:
        n = spark.read.parquet(path).count()
    except Exception:  # noqa: BLE001  health must not raise
        return spark.createDataFrame([("degraded", None)], "status string, chunks bigint")
    return spark.createDataFrame([("ok", n)], "status string, chunks bigint")
