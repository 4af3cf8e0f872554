"""Queries that write what the scans read, by the sinks or in the original layout, and read it back.

Each writes to a folder of its own in the shared folder. Their DuckDB equivalents start from the tables.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .. import schemas
from ..functions import register, text, urls
from ..operators import context, dedup, frontier, lookup, stats
from ..session import scratch
from ..sources import adapters, downloads, extract, readers, sinks
from . import corpus
from .registry import _HYBRID, _UNION, _canonical, _cleaned, _flat, _sources, _strip, query, table

_ESCAPED = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").withColumn("id", F.col("doc_id").cast("string"))


def _objects(df: DataFrame, path: str, value: Column, files: int = 16) -> None:
    """JSON texts of groups of rows, a file each. ``value`` sums a group up."""
    df.groupBy(F.pmod(F.xxhash64(*df.columns[:1]), F.lit(files)).alias("f")).agg(value.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)


def _digest(c: str) -> Column:
    return F.md5(F.col(c).cast("binary")).alias("digest")


_NONE_LEFT = "content <> ''"


@query("WITH " + _cleaned("documents", "doc_id", "text") + f" SELECT 'news-' || c.doc_id AS doc_id, 'T ' || c.doc_id AS title, source AS category, md5(content) AS digest FROM cleaned c JOIN documents d USING (doc_id) WHERE {_NONE_LEFT}")
def news_roundtrip(spark, sf_dir):
    """Articles as HTML or as text, an older version of each beside it."""
    docs = _docs(spark, sf_dir)
    marked = F.col("text")
    for old, new in _ESCAPED:
        marked = F.replace(marked, F.lit(old), F.lit(new))
    html = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<html><body><nav>n</nav><p>"), marked, F.lit("</p></body></html>"))).otherwise("")
    raw = docs.select(
        F.col("id").alias("source_id"), F.lit("1").alias("type_id"), F.concat(F.lit("https://h/"), "id").alias("url"), F.concat(F.lit("  T "), "id", F.lit(" ")).alias("title"), F.col("source").alias("category"),
        html.alias("content_html"), F.col("text").alias("content_text"), F.array().cast(f"array<{schemas.ATTACHMENT}>").alias("attachments"), F.lit("2024-01-02").alias("published_at"), F.lit("2024-01-03T00:00:00").alias("crawled_at"),
        F.create_map().cast("map<string,string>").alias("metadata"), text.slugify(F.coalesce("source", F.lit(""))).alias("category_slug"),
    )
    older = raw.withColumns({"crawled_at": F.lit("2023-01-01T00:00:00"), "content_text": F.lit("old"), "content_html": F.lit("old")})
    path = scratch(spark, "news")
    sinks.news(raw.unionByName(older), f"{path}/news")
    return readers.news(spark, f"{path}/news", lines=True).select("doc_id", "title", "category", _digest("content"))


@query(f"SELECT doc_id, kind, md5(c) AS digest FROM (SELECT doc_id, kind, {_strip('content')} AS c FROM {_UNION}) WHERE c <> ''")
def cleaned_roundtrip(spark, sf_dir):
    path = scratch(spark, "cleaned")
    sinks.documents(_sources(spark, sf_dir), path)
    return readers.cleaned(spark, f"{path}/documents", lines=True).select("doc_id", "kind", _digest("content"))


@query(f"SELECT kind, count(*) AS documents, CAST(sum(length(content)) AS BIGINT) AS chars FROM {_UNION} GROUP BY GROUPING SETS ((kind), ())")
def cleaned_manifest(spark, sf_dir):
    path = scratch(spark, "manifest")
    sinks.documents(_sources(spark, sf_dir), path)
    return spark.read.schema("kind string, documents bigint, chars bigint").json(f"{path}/manifest")


@F.arrow_udf(BinaryType())
def docx(content: pa.Array) -> pa.Array:
    """A DOCX file with a paragraph per line."""

    def one(value: str) -> bytes:
        space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in value.split("\n"))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{space}"><w:body>{lines}</w:body></w:document>')
        return out.getvalue()

    return pa.array([None if v is None else one(v) for v in content.to_pylist()], pa.binary())


def _sightings(docs: DataFrame) -> DataFrame:
    kind = F.when(F.col("doc_id") % 5 == 4, "zip").otherwise("docx")
    name = F.concat(F.lit("file-"), "id", F.lit("."), kind)
    where = F.concat(F.lit("attachments/"), F.coalesce("source", F.lit("none")), F.lit("/"), name)
    return docs.select(dedup.content_key("text").alias("checksum"), F.col("doc_id").alias("seq"), F.col("source").alias("source_id"), F.concat(F.lit("u"), "id").alias("url"), where.alias("local_path"), F.length("text").cast("bigint").alias("size_bytes"), kind.alias("file_type"), name.alias("filename"), "text")


@query(
    "WITH f AS (SELECT sha256(text) AS checksum, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1), " + _cleaned("(SELECT doc_id, text FROM documents JOIN f USING (doc_id))", "doc_id", "text")
    + f" SELECT 'att-' || substr(checksum, 1, 12) AS doc_id, 'file-' || doc_id AS title, 'u' || doc_id AS source_url, source AS source_id, md5(content) AS digest FROM cleaned JOIN f USING (doc_id) JOIN documents USING (doc_id) WHERE doc_id % 5 <> 4 AND {_NONE_LEFT}"
)
def attachments_roundtrip(spark, sf_dir):
    """Files of the texts, some of a kind that isn't read, indexed by checksum; equal texts are one attachment."""
    seen, path = _sightings(_docs(spark, sf_dir)), scratch(spark, "attachments")
    record = F.struct("checksum", "local_path", "size_bytes", "file_type", "urls", "referenced_by", "first_source_id")
    _objects(dedup.attachment_index(seen.drop("filename", "text")), f"{path}/index", F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("checksum"), record)))))
    sinks.attachments(seen.select("source_id", "filename", docx(F.col("text")).alias("content"), "seq"), f"{path}/files")
    found = readers.attachments(readers.attachment_index(spark, f"{path}/index"), spark.read.parquet(f"{path}/files"), extract.extract_udf())
    return found.select("doc_id", "title", "source_url", "source_id", _digest("content"))


@query("SELECT checksum, CAST(count(DISTINCT source) AS BIGINT) AS n_sources, CAST(count(*) AS BIGINT) AS n_urls, min_by(doc_id, (doc_id % 2, doc_id)) AS first_id FROM (SELECT sha256(text) AS checksum, source, doc_id FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def index_upsert(spark, sf_dir):
    """An index of half of the files, kept as a snapshot, then taken up with the other half's."""
    seen, path = _sightings(_docs(spark, sf_dir)).drop("filename", "text"), scratch(spark, "index")
    first = dedup.attachment_index(seen.where("seq % 2 = 0"))
    sinks.snapshot(first, path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in first.schema.fields)
    sinks.snapshot(dedup.upsert_index(sinks.read_snapshot(spark, path, schema), seen.where("seq % 2 = 1")), path)
    index = sinks.read_snapshot(spark, path, schema)
    return index.select("checksum", F.size("referenced_by").cast("bigint").alias("n_sources"), F.size("urls").cast("bigint").alias("n_urls"), F.regexp_extract("local_path", r"file-(\d+)\.", 1).cast("bigint").alias("first_id"))


@query("SELECT doc_id, doc_id % 3 = 0 AS reused FROM documents WHERE text IS NOT NULL")
def attachment_reuse(spark, sf_dir):
    """Bytes are reused if they are indexed and their file still exists; here each third file does."""
    seen = _sightings(_docs(spark, sf_dir)).drop("filename", "text").withColumn("checksum", F.sha2(F.col("seq").cast("string").cast("binary"), 256))
    index = dedup.attachment_index(seen)
    listing = index.where(F.regexp_extract("local_path", r"file-(\d+)\.", 1).cast("bigint") % 3 == 0).select(F.col("local_path").alias("path"))
    return lookup.reuse_or_store(seen, index, listing).select(F.col("seq").alias("doc_id"), "reused")


def _log(docs: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    provider = F.when(i % 2 == 0, "sharepoint").otherwise("google_drive")
    status = F.element_at(F.array(*map(F.lit, ("ok", "failed", "skipped"))), (i % 3 + 1).cast("int"))
    return docs.select(F.concat(F.lit("https://f/"), "id").alias("url"), provider.alias("provider"), status.alias("status"), F.concat(F.lit("name.of-"), "id", F.lit(".txt")).alias("file"), F.when(status == "failed", "HTTP 404").alias("reason"), F.length("text").cast("bigint").alias("size"), F.col("id").alias("source_id"), F.col("source").alias("category"), F.concat(F.lit("Title "), "id").alias("title"), F.col("text").cast("binary").alias("content"))


def _by_provider(record: Column) -> Column:
    one = lambda p: F.map_from_entries(F.collect_list(F.when(F.col("provider") == p, F.struct(F.col("url"), record)))).alias(p)
    return F.to_json(F.struct(one("sharepoint"), one("google_drive")))


_PROVIDER = "CASE WHEN doc_id % 2 = 0 THEN 'sharepoint' ELSE 'google_drive' END"


@query("WITH " + _cleaned("documents", "doc_id", "text") + f" SELECT 'ext-name.of-' || doc_id AS doc_id, 'Title ' || doc_id AS title, 'https://f/' || doc_id AS source_url, source AS category, {_PROVIDER} AS origin, md5(content) AS digest FROM cleaned JOIN documents USING (doc_id) WHERE doc_id % 3 = 0 AND {_NONE_LEFT}")
def external_roundtrip(spark, sf_dir):
    """Downloaded text files and their log; those of status ok count."""
    log, path = _log(_docs(spark, sf_dir)), scratch(spark, "external")
    _objects(log.drop("content"), f"{path}/log", _by_provider(F.struct("status", "file", "reason", "size", "source_id", "category", "title")))
    log.select(F.col("file").alias("file_name"), "content").write.parquet(f"{path}/files")
    found = readers.external(readers.download_log(spark, f"{path}/log"), spark.read.parquet(f"{path}/files"), extract.extract_udf(60))
    return found.select("doc_id", "title", "source_url", "category", F.col("metadata")["origin"].alias("origin"), _digest("content"))


@query(f"SELECT {_PROVIDER} AS provider, CASE doc_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'failed' ELSE 'skipped' END AS status, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def download_log_roundtrip(spark, sf_dir):
    path = scratch(spark, "log")
    sinks.download_log(_log(_docs(spark, sf_dir)).drop("content"), path)
    return spark.read.schema("provider string, status string, n bigint").json(f"{path}/stats")


@query(f"SELECT {_PROVIDER} AS provider, 'https://f/' || doc_id AS url, CAST(doc_id AS VARCHAR) AS source_id, source AS category, 'Title ' || doc_id AS title FROM documents WHERE text IS NOT NULL")
def links_manifest_scan(spark, sf_dir):
    path = scratch(spark, "links")
    _objects(_log(_docs(spark, sf_dir)).drop("content"), f"{path}/links", _by_provider(F.struct("source_id", "category", "title")))
    return readers.links_manifest(spark, f"{path}/links").select("provider", "url", "source_id", "category", "title")


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL GROUP BY lang UNION ALL SELECT 'all', 3 * count(*), 3 * CAST(sum(length(text)) AS BIGINT) FROM documents WHERE text IS NOT NULL")
def collection_roundtrip(spark, sf_dir):
    """A collection replaced beside one that is added to: chunks that are added again are there twice."""
    chunks, path = _docs(spark, sf_dir).select("text", "lang", F.array(F.lit(0.5)).alias("embedding")), scratch(spark, "collection")
    sinks.chunks(chunks.withColumn("text", F.lit("old")), path, "main")
    sinks.chunks(chunks, path, "other")
    sinks.chunks(chunks, path, "main", clear=True)
    for _ in range(2):
        sinks.chunks(chunks, path, "other")
    sums = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"))
    other = sums(readers.collection(spark, path, "other")).select(F.lit("all").alias("lang"), "n", "chars").where("n > 0")
    return sums(readers.collection(spark, path, "main"), "lang").unionByName(other)


@query("SELECT 'ok' AS status, count(*) AS chunks FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'degraded', NULL")
def collection_status(spark, sf_dir):
    """The state of an index, and of one that isn't there."""
    path = scratch(spark, "status")
    sinks.chunks(_docs(spark, sf_dir).select("text"), f"{path}/index", "main")
    return corpus.status(spark, f"{path}/index").unionByName(corpus.status(spark, f"{path}/none"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN length(text) ELSE length(regexp_replace(text, '[^\\x00-\\x7f]', '', 'g')) + 2 END AS n, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE 'éÿ' || regexp_replace(text, '[^\\x00-\\x7f]', '', 'g') END) AS digest FROM documents WHERE text IS NOT NULL")
def decode_fallback(spark, sf_dir):
    """Bytes that are UTF-8, and bytes that aren't and so are Latin-1."""
    latin = F.concat(F.unhex(F.lit("E9FF")), F.regexp_replace("text", r"[^\x00-\x7f]", "").cast("binary"))
    data = F.when(F.col("doc_id") % 2 == 0, F.col("text").cast("binary")).otherwise(latin)
    found = _docs(spark, sf_dir).select("doc_id", text.decode_bytes(data).alias("t"))
    return found.select("doc_id", F.length("t").cast("bigint").alias("n"), _digest("t"))


@query("SELECT page_id, 'My%20File%3F' || page_id || '.docx' AS file_name, 'docx' AS suffix, page_id || '_My File_' || page_id || '.docx' AS safe, CASE WHEN page_id % 2 = 0 THEN 'pdf' ELSE 'docx' END AS ext, 'a.b' || page_id || CASE WHEN page_id % 2 = 0 THEN '.pdf' ELSE '.docx' END AS named, 'ID' || page_id AS drive_id, rtrim(url, '/') || '/' AS slashed FROM pages")
def file_names(spark, sf_dir):
    """Names, suffixes and ids of files behind links."""
    key = F.col("page_id").cast("string")
    link = F.concat(F.lit("https://h.example/x/My%20File%3F"), key, F.lit(".docx"))
    ext = urls.resolve_extension(F.when(F.col("page_id") % 2 == 0, "unknown").otherwise("docx"), F.lit("application/pdf"))
    return table(spark, sf_dir, "pages").select(
        "page_id", urls.file_name(link).alias("file_name"), urls.file_suffix(urls.file_name(link)).alias("suffix"), urls.safe_filename(link, key, F.lit(1)).alias("safe"), ext.alias("ext"),
        urls.with_extension(F.concat(F.lit("a.b"), key, F.lit(".docx")), ext).alias("named"), urls.drive_file_id(F.concat(F.lit("https://d/file/d/ID"), key, F.lit("/view"))).alias("drive_id"), urls.with_slash(F.concat("url", F.lit("//"))).alias("slashed"),
    )


@query("SELECT type_id, CAST(count(*) FILTER (WHERE NOT s) AS BIGINT) AS processed, CAST(count(*) FILTER (WHERE s) AS BIGINT) AS skipped, CAST(count(*) FILTER (WHERE NOT s AND k = 'list') AS BIGINT) AS list_pages, CAST(count(*) FILTER (WHERE NOT s AND k = 'detail') AS BIGINT) AS detail_pages, CAST(sum(page_id % 7) AS BIGINT) AS new_links FROM (SELECT page_id, CAST(page_id % 4 AS VARCHAR) AS type_id, page_id % 5 = 0 AS s, CASE WHEN page_id % 3 = 0 THEN 'list' ELSE 'detail' END AS k FROM pages) GROUP BY type_id")
def crawl_counters(spark, sf_dir):
    i = F.col("page_id")
    visits = table(spark, sf_dir, "pages").select((i % 4).cast("string").alias("type_id"), F.when(i % 3 == 0, "list").otherwise("detail").alias("kind"), (i % 5 == 0).alias("skipped"), (i % 7).alias("new_links"))
    return stats.crawl_stats(visits)


_PAGES, _TYPES = 6, 4


@query(
    f"WITH l AS (SELECT t, p FROM range(0, {_TYPES}) a(t), range(1, {_PAGES + 1}) b(p)), d AS (SELECT t, p, unnest([p * 2, p * 2 + 1, p * 2 + 2]) AS d FROM l), "
    "w AS (SELECT d, min((p, t)) AS first FROM d GROUP BY d), v AS (SELECT 'list' AS kind, t, p - 1 AS level FROM l UNION ALL SELECT 'detail', first[2], first[1] FROM w) "
    "SELECT kind, CAST(t AS VARCHAR) AS type_id, CAST(level AS INTEGER) AS level, count(*) AS visits FROM v GROUP BY ALL".replace("first[2]", "struct_extract(first, 2)").replace("first[1]", "struct_extract(first, 1)")
)
def frontier_pages(spark, sf_dir):
    """A site of several types whose list pages lead to a next page and to details, some listed twice and by all types: the first type has them."""
    types = spark.range(_TYPES).select(F.col("id").cast("string").alias("type_id"), F.col("id").alias("type_ord"))
    page = F.coalesce(F.regexp_extract("url", r"[?&]page=(\d+)", 1).try_cast("bigint"), F.lit(1))

    def expand(visits: DataFrame) -> DataFrame:
        lists = visits.where(F.col("kind") == "list").withColumn("p", page)
        links = F.concat(
            F.transform(F.sequence(F.col("p") * 2, F.col("p") * 2 + 2), lambda d: F.struct(F.concat(F.lit("http://h/News/Detail/"), d.cast("string")).alias("url"), F.lit("detail").alias("kind"))),
            F.when(F.col("p") < _PAGES, F.array(F.struct(urls.next_page(F.col("url")).alias("url"), F.lit("list").alias("kind")))).otherwise(F.array()),
        )
        each = lists.select(F.col("url_hash").alias("parent_hash"), "depth", F.posexplode(links).alias("pos", "x"))
        return each.select("parent_hash", "pos", "x.url", (F.col("depth") + 1).alias("depth"), "x.kind")

    found = frontier.crawl(frontier.seeds(types, "http://h/{type_id}/list"), expand)
    return found.groupBy("kind", "type_id", "level").agg(F.count("*").alias("visits"))


@query("SELECT CAST(to_json({doc_id: doc_id, source: coalesce(source, ''), n_chars: n_chars, tags: ['a', 'b']}) AS VARCHAR) AS value FROM documents WHERE n_chars IS NOT NULL")
def json_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("n_chars is not null")
    return sinks.as_json(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_chars", F.array(F.lit("a"), F.lit("b")).alias("tags")))


@query("SELECT o_orderkey, 'key ' || o_orderkey || ' | ' || o_orderstatus || chr(10) || 'only' AS lines FROM orders")
def table_lines(spark, sf_dir):
    """Rows of cells as lines: blanks squeezed, empty cells and rows dropped at the ends."""
    key = F.col("o_orderkey").cast("string")
    none = F.lit(None).cast("string")
    rows = F.array(F.array(F.concat(F.lit(" key \n "), key), F.concat("o_orderstatus", F.lit(" "))), F.array(none, F.lit("  ")), F.array(F.lit("only"), none))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text.format_table(rows), "\n").alias("lines"))


@query("WITH " + _cleaned("documents", "doc_id", "text") + ", h AS (SELECT page_id, substr(md5(canonical), 1, 16) AS hash FROM " + _canonical("pages") + ") SELECT 'document' AS what, doc_id AS id, md5(content) AS value FROM cleaned WHERE content IS NOT NULL UNION ALL SELECT 'page', page_id, hash FROM h")
def sql_functions(spark, sf_dir):
    """The text functions under their SQL names."""
    register.register(spark)
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    args = {"docs": docs, "pages": pages}
    return spark.sql("SELECT 'document' AS what, doc_id AS id, md5(cast(clean_text(text) AS binary)) AS value FROM {docs} WHERE text IS NOT NULL UNION ALL SELECT 'page', page_id, url_hash(url) FROM {pages}", **args)


@query("SELECT 'https://f/x/file-' || page_id || '.pdf' AS url, CASE page_id % 4 WHEN 1 THEN 404 WHEN 3 THEN NULL ELSE 200 END AS status, CASE page_id % 4 WHEN 0 THEN 2004 + page_id % 10 WHEN 2 THEN 2006 END AS n_bytes, CASE page_id % 4 WHEN 1 THEN 'HTTP 404' WHEN 3 THEN 'down' END AS error FROM pages")
def fetch_pages(spark, sf_dir):
    """Fetching with a site that gives pages, statuses and broken connections, each tried three times."""
    fetch = adapters.with_retry(adapters.numbered_site, attempts=3, backoff=0.0)
    asked = table(spark, sf_dir, "pages").select(F.concat(F.lit("https://f/x/file-"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("url"))
    return adapters.fetch_pages(asked, fetch).select("url", "status", F.length("body").cast("bigint").alias("n_bytes"), "error")


@query(
    "SELECT page_id % 2 = 0 AS even, url, CASE WHEN page_id % 5 = 0 THEN 'skipped' WHEN page_id % 4 = 0 THEN 'ok' ELSE 'failed' END AS status, page_id || '_file-' || page_id || '.pdf' AS file, "
    "CASE WHEN page_id % 5 = 0 THEN NULL ELSE CASE page_id % 4 WHEN 1 THEN 'HTTP 404' WHEN 2 THEN 'not a file' WHEN 3 THEN 'down' END END AS reason, CASE WHEN page_id % 5 <> 0 AND page_id % 4 = 0 THEN 2004 + page_id % 10 END AS size, repeat('t', 60) AS title "
    "FROM (SELECT page_id, 'https://f/x/file-' || page_id || '.pdf' AS url FROM pages)"
)
def download_files(spark, sf_dir):
    """Downloads of two providers, some there already; what is no file has failed, and titles are cut."""
    key = F.col("page_id").cast("string")
    link = F.concat(F.lit("https://f/x/file-"), key, F.lit(".pdf"))
    manifest = table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 2 == 0, "sharepoint").otherwise("google_drive").alias("provider"), link.alias("url"), key.alias("source_id"), F.lit("c").alias("category"), F.lit("t" * 80).alias("title"))
    there = manifest.where("cast(source_id as bigint) % 5 = 0").select(F.concat("source_id", F.lit("_file-"), "source_id", F.lit(".pdf")).alias("file_name"), F.lit(2000).cast("bigint").alias("length"))
    log = downloads.download(downloads.plan(manifest, there), adapters.numbered_site)
    return log.select((F.col("provider") == "sharepoint").alias("even"), "url", "status", "file", "reason", "size", "title")


@query(_HYBRID + "SELECT query_id, md5(string_split(text, chr(10) || chr(10) || '---' || chr(10) || chr(10))[1]) AS digest FROM h WHERE rank = 1")
def answer_extract(spark, sf_dir):
    """Questions answered by the offline generator from the context of the fused hits."""
    found = context.format_context(_flat(spark, sf_dir))
    return found.select("query_id", F.md5(adapters.extractive_answer(F.col("context")).cast("binary")).alias("digest"))


_HREFS = "regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)"


@query(f"SELECT page_id, array_to_string(list_filter(w, lambda x, i: list_position(list_transform(w, lambda y: lower(y)), lower(x)) = i), ' ') AS hrefs FROM (SELECT page_id, list_concat({_HREFS}, ['/A', '/a', '/B', '/A']) AS w FROM pages)")
def distinct_hrefs(spark, sf_dir):
    """Of a page's anchors, those of equal lower-case targets once, the first."""
    found = F.regexp_extract_all("html", F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(found, F.array(*map(F.lit, ("/A", "/a", "/B", "/A")))).alias("w"))
    return pages.select("page_id", F.array_join(dedup.distinct_in_array("w", F.lower), " ").alias("hrefs"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT sha256(text)) FROM documents) AS checksums, (SELECT count(*) FROM pages) AS waiting")
def corpus_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.count_distinct(dedup.content_key("text")).alias("checksums"))
    return docs.join(F.broadcast(table(spark, sf_dir, "pages").agg(F.count("*").alias("waiting"))))
