"""Scans of the corpus's files. Unreadable files and rows without content are left out, as the originals are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import html as H
from ..functions import text as T


def _json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """One row per JSON file below ``path``, or per line of files in partitions, with its path; corrupt ones dropped."""
    reader = spark.read.schema(f"{schema}, _corrupt_record string").option("pathGlobFilter", "*.json")
    files = (reader if lines else reader.option("multiLine", True).option("recursiveFileLookup", True)).json(path)
    return files.select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name")).where("_corrupt_record is null").drop("_corrupt_record")


def _has_text(c: str) -> Column:
    return F.length(T.strip(F.coalesce(c, F.lit("")))) > 0


def _object(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key and value of a JSON object in a file; nothing if the file is corrupt."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, {value}>").alias("m"))
    return parsed.select(F.explode("m").alias("key", "value"))


def with_text(df: DataFrame, c: str) -> DataFrame:
    """Rows whose text, a computed column, isn't blank. A filter would be evaluated below the steps that compute it, and repeat them."""
    others = [x for x in df.columns if x != c]
    kept = F.filter(F.array(c), lambda x: F.length(T.strip(F.coalesce(x, F.lit("")))) > 0)
    return df.select(*others, F.explode(kept).alias(c)).select(*df.columns)


def news(spark: SparkSession, path: str, zero_width: str = "parity", limit: int | None = None, lines: bool = False) -> DataFrame:
    """Cleaned documents of kind 'news'; with ``limit``, the first in path order.

    The folder holds a JSON file per article or, with ``lines``, what the news sink writes.
    """
    raw = _json(spark, path, schemas.RAW_NEWS, lines)
    html = H.clean_html(raw, "content_html", "from_html", zero_width)
    both = T.clean_text(html, "content_text", "from_text", zero_width)
    content = F.when(_has_text("content_html"), F.col("from_html")).otherwise(F.coalesce("from_text", F.lit("")))
    out = both.select(
        F.concat(F.lit("news-"), "source_id").alias("doc_id"),
        F.lit("news").alias("kind"),
        T.strip(F.coalesce("title", F.lit(""))).alias("title"),
        T.strip(content).alias("content"),
        F.col("url").alias("source_url"),
        "category",
        F.coalesce("source_id", F.lit("")).alias("source_id"),
        F.array().cast("array<string>").alias("referenced_by"),
        F.create_map(F.lit("published_at"), "published_at", F.lit("type_id"), "type_id").alias("metadata"),
        "file_path",
    )
    out = with_text(out, "content")
    return out.orderBy("file_path").limit(limit) if limit else out


def attachment_index(spark: SparkSession, path: str) -> DataFrame:
    """Records of an attachment index; no rows if the file is corrupt."""
    return _object(spark, path, schemas.INDEX_RECORD).select("value.*", F.col("key").alias("index_key")).withColumn("checksum", F.coalesce("checksum", "index_key")).drop("index_key")


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, file_name and content of files below a folder."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return read.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "content", "length")


def attachments(index: DataFrame, stored: DataFrame, extract, zero_width: str = "parity") -> DataFrame:
    """Documents of kind 'attachment': indexed pdf and docx files that exist and have text.

    ``stored`` has file_name and content; ``extract`` turns (file_name, content) columns into text.
    """
    name = F.element_at(F.split("local_path", "/"), -1)
    wanted = index.where(F.col("file_type").isin("pdf", "docx")).withColumn("__name", name)
    joined = wanted.join(stored.select("file_name", "content"), F.col("__name") == F.col("file_name")).withColumn("__text", extract(F.col("file_name"), F.col("content")))
    cleaned = T.clean_text(joined.where(_has_text("__text")), "__text", "__clean", zero_width)
    return cleaned.select(
        F.concat(F.lit("att-"), F.substring("checksum", 1, 12)).alias("doc_id"),
        F.lit("attachment").alias("kind"),
        F.regexp_replace("__name", r"(?<=.)\.[^.]*$", "").alias("title"),
        T.strip(F.col("__clean")).alias("content"),
        F.try_element_at("urls", F.lit(1)).alias("source_url"),
        F.lit(None).cast("string").alias("category"),
        F.col("first_source_id").alias("source_id"),
        F.coalesce("referenced_by", F.array().cast("array<string>")).alias("referenced_by"),
        F.create_map(F.lit("checksum"), "checksum", F.lit("file_type"), "file_type", F.lit("size_bytes"), F.col("size_bytes").cast("string")).alias("metadata"),
    )


def download_log(spark: SparkSession, path: str) -> DataFrame:
    """provider, url and record of every download; no rows if the file is corrupt."""
    log = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.DOWNLOAD_LOG).alias("l"))
    one = lambda p: log.select(F.lit(p).alias("provider"), F.explode(f"l.{p}").alias("url", "r")).select("provider", "url", "r.*")
    return one("sharepoint").unionByName(one("google_drive"))


def links_manifest(spark: SparkSession, path: str) -> DataFrame:
    """provider, url, source_id, category and title of the links to download."""
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.LINKS_MANIFEST).alias("l"))
    one = lambda p: m.select(F.lit(p).alias("provider"), F.explode(f"l.{p}").alias("url", "r")).select("provider", "url", "r.*")
    return one("sharepoint").unionByName(one("google_drive"))


def external(log: DataFrame, stored: DataFrame, extract, include_skipped: bool = False, zero_width: str = "parity") -> DataFrame:
    """Documents of kind 'external': downloads with status ok whose file exists and has text.

    ``include_skipped`` also takes files that an earlier run had downloaded. Ids are cut to 40
    characters of the file's stem and may collide, as in the original.
    """
    ok = log.where(F.col("status").isin(*(["ok", "skipped"] if include_skipped else ["ok"])))
    joined = ok.join(stored.select("file_name", "content"), F.col("file") == F.col("file_name")).withColumn("__text", extract(F.col("file_name"), F.col("content")))
    cleaned = T.clean_text(joined.where(_has_text("__text")), "__text", "__clean", zero_width)
    stem = F.regexp_replace("file", r"(?<=.)\.[^.]*$", "")
    return cleaned.select(
        F.concat(F.lit("ext-"), F.substring(stem, 1, 40)).alias("doc_id"),
        F.lit("external").alias("kind"),
        F.coalesce("title", stem).alias("title"),
        T.strip(F.col("__clean")).alias("content"),
        F.col("url").alias("source_url"),
        "category",
        F.coalesce("source_id", F.lit("")).alias("source_id"),
        F.array().cast("array<string>").alias("referenced_by"),
        F.create_map(F.lit("origin"), "provider", F.lit("file_name"), "file", F.lit("size_bytes"), F.col("size").cast("string")).alias("metadata"),
    )


def cleaned(spark: SparkSession, path: str, limit: int | None = None, lines: bool = False) -> DataFrame:
    """Documents of a cleaned folder without its manifest; with ``limit``, the first in path order.

    The folder holds a JSON file per document or, with ``lines``, what the documents sink writes.
    """
    docs = _json(spark, path, schemas.DOCUMENT, lines).where("file_name <> 'manifest.json'").where(_has_text("content"))
    docs = docs.withColumns({"title": T.strip(F.coalesce("title", F.lit(""))), "content": T.strip(F.col("content")), "source_id": F.coalesce("source_id", F.lit("")), "referenced_by": F.coalesce("referenced_by", F.array().cast("array<string>"))})
    docs = docs.drop("file_name")
    return docs.orderBy("file_path").limit(limit) if limit else docs


def collection(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Chunks of a named collection; the filter prunes partitions and vectors are read only if used."""
    return spark.read.parquet(path).where(F.col("collection") == name)
