"""URL functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# scheme, authority, path (with parameters), query, fragment; every part may be missing
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def quote_plus(text: Column) -> Column:
    """Percent-encoding with '+' for blanks, '*' encoded and '~' not."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def unquote_plus(text: Column) -> Column:
    """Percent-decoding; text with a malformed escape only has '+' replaced."""
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def canonicalize(url: Column) -> Column:
    """Scheme and authority in lower case, '/' for an empty path, query sorted without empty values, no fragment."""
    pairs = F.transform(
        F.filter(F.split(part(url, 4), "&", -1), lambda p: p.rlike("(?s)^[^=]*=.")),
        lambda p: F.struct(unquote_plus(F.regexp_extract(p, "(?s)^([^=]*)=", 1)).alias("k"), unquote_plus(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v")),
    )
    query = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(quote_plus(p["k"]), F.lit("="), quote_plus(p["v"]))), "&")
    scheme, host, path = F.lower(part(url, 1)), F.lower(part(url, 2)), part(url, 3)
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when((host != "") | (scheme != ""), F.concat(F.lit("//"), host)).otherwise(""),
        F.when(path == "", "/").otherwise(path),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def url_hash(url: Column, algorithm: str = "md5", length: int | None = 16) -> Column:
    """Leading hex digits of a digest of the canonical URL; unknown algorithms mean md5."""
    canon = canonicalize(url).cast("binary")
    digest = {"sha1": F.sha1(canon), "sha256": F.sha2(canon, 256), "sha512": F.sha2(canon, 512)}.get(algorithm, F.md5(canon))
    return F.substring(digest, 1, length) if length else digest


def classify(url: Column, listing: str = r"/News/Type/(\d+)", detail: str = r"/News/Detail/(\d+)") -> Column:
    return F.when(url.rlike(listing), "list").when(url.rlike(detail), "detail").otherwise("other")


def extract_id(url: Column, pattern: str, fallback: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")), fallback)


def next_page(url: Column) -> Column:
    """The URL with its page number raised by one, or with page=2 added."""
    n = F.regexp_extract(url, r"[?&]page=(\d+)", 1)
    raised = F.replace(url, F.concat(F.lit("page="), n.cast("bigint").cast("string")), F.concat(F.lit("page="), (n.cast("bigint") + 1).cast("string")))
    return F.when(n != "", raised).otherwise(F.concat(url, F.when(F.contains(url, F.lit("?")), "&page=2").otherwise("?page=2")))


def _without_dots(path: Column) -> Column:
    """A path with its '.' and '..' segments resolved."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)

    def step(acc, p):
        return F.when(p == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).when(p == ".", acc).otherwise(F.concat(acc, F.array(p)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    closed = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.array_join(closed, "/")


def join(base: Column, href: Column) -> Column:
    """An href resolved against a base URL."""
    own = F.concat(part(base, 1), F.lit(":"))
    root = F.concat(own, F.lit("//"), part(base, 2))
    tail = F.concat(F.when(F.contains(href, F.lit("?")), F.concat(F.lit("?"), part(href, 4))).otherwise(""), F.when(F.contains(href, F.lit("#")), F.concat(F.lit("#"), part(href, 5))).otherwise(""))
    folder = F.regexp_extract(F.when(part(base, 3) == "", "/").otherwise(part(base, 3)), "(?s)^(.*/)", 1)
    path = part(href, 3)
    return (
        F.when(href == "", base)
        .when(part(href, 1) != "", href)
        .when(href.startswith("//"), F.concat(own, href))
        .when(href.startswith("/"), F.concat(root, _without_dots(path), tail))
        .when(path == "", F.concat(root, part(base, 3), F.when(F.contains(href, F.lit("?")), tail).otherwise(F.concat(F.when(F.contains(base, F.lit("?")), F.concat(F.lit("?"), part(base, 4))).otherwise(""), tail))))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, path)), tail))
    )


def file_name(url: Column) -> Column:
    return F.regexp_extract(part(url, 3), "(?s)([^/]*)/*$", 1)


def file_suffix(name: Column) -> Column:
    """Lower-case suffix without its dot; '' if there is none."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^./]+)$", 1))


# Extensions of attachments, and of known content types.
ATTACHMENT_EXTENSIONS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".rar")
KNOWN_EXTENSIONS = ("pdf", "doc", "docx", "xls", "xlsx", "zip", "txt")
CONTENT_TYPES = {
    "application/pdf": "pdf",
    "application/msword": "doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.ms-excel": "xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/zip": "zip",
    "application/x-zip-compressed": "zip",
    "text/plain": "txt",
}


def is_attachment(href: Column) -> Column:
    """Whether a stripped href ends in an attachment's extension and leads off the page."""
    low = F.lower(href)
    ends = F.lit(False)
    for ext in ATTACHMENT_EXTENSIONS:
        ends = ends | low.endswith(ext)
    return (href != "") & ~href.startswith("#") & ~href.startswith("mailto:") & ends


def is_detail_link(href: Column) -> Column:
    return href.rlike(r"(?U)^/News/Detail/(\d+)(?:/[^\n]*)?\n?$")


def resolve_extension(file_type: Column, content_type: Column) -> Column:
    """The declared type where known, else what the content type says, else ''."""
    types = F.create_map(*(F.lit(x) for kv in CONTENT_TYPES.items() for x in kv))
    said = F.coalesce(F.try_element_at(types, content_type), F.lit(""))
    declared = F.when(file_type == "unknown", said).otherwise(file_type)
    return F.when(declared.isin(*KNOWN_EXTENSIONS), declared).otherwise(said)


def with_extension(name: Column, ext: Column) -> Column:
    """A file name whose suffix is ``ext``, if that isn't empty."""
    stem = F.regexp_replace(name, r"(?s)(?<=.)\.[^./]*$", "")
    return F.when((ext == "") | F.lower(name).endswith(F.concat(F.lit("."), ext)), name).otherwise(F.concat(stem, F.lit("."), ext))


def safe_filename(url: Column, source_id: Column, index: Column) -> Column:
    """A name for a downloaded file: source id, cleaned base of up to 60 characters, suffix ('.pdf' if none)."""
    raw = F.regexp_extract(part(url, 3), "(?s)([^/]*)$", 1)
    plain = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    name = F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}_\-. ]", "_"), "^ +| +$", "")
    name = F.when(F.length(name) < 3, F.concat(F.lit("file_"), source_id, F.lit("_"), index.cast("string"))).otherwise(name)
    ext = F.regexp_extract(name, r"(?s)^\.*[^.].*?(\.[^.]*)$", 1)
    base = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return F.concat(source_id, F.lit("_"), F.substring(base, 1, 60), F.when(ext == "", ".pdf").otherwise(ext))


def drive_file_id(url: Column) -> Column:
    """The file id in a shared-drive link, '' if there is none."""
    return F.regexp_extract(url, r"/file/d/([^/]+)", 1)


def is_html_reply(data: Column, least_bytes: int = 1000) -> Column:
    """Whether downloaded bytes are too few or start like a web page instead of a file."""
    head = F.lower(F.decode(F.substring(data, 1, 100), "ISO-8859-1"))
    return (F.length(data) < least_bytes) | F.contains(head, F.lit("<html")) | F.contains(head, F.lit("<!doctype html"))


def with_slash(base: Column) -> Column:
    """A base URL that ends in one slash."""
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"))
