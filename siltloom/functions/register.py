"""The text functions under SQL names: temporary SQL functions, which Catalyst inlines like any expression."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import SparkSession

from . import chunk, html, text, urls


def _s(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: Callable[[str], str]) -> str:
    """``body`` of a name for ``value``, so that it is evaluated once."""
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def _replaced(x: str, *pairs: tuple[str, str]) -> str:
    return reduce(lambda a, p: f"regexp_replace({a}, {_s(p[0])}, {_s(p[1])})", pairs, x)


def _strip(x: str) -> str:
    return _replaced(x, (text.STRIP, ""))


def _clean_text(x: str) -> str:
    """The steps of the cleaner over a string that is in normal form."""
    chars = [(old.encode().decode("latin-1") if old in text.ZERO_WIDTH else old, new) for old, new in text.CHAR_REPLACEMENTS]
    plain = reduce(lambda a, p: f"replace({a}, {_s(p[0])}, {_s(p[1])})", chars, x)
    welded = _replaced(plain, *((text.quoted(p), "") for p in text.INLINE_JUNK), ("[ \t]+/", "/"), ("/[ \t]+", "/"), (r"(?U)(?<=\d)[ \t]+(?=\d)", ""))
    junk = "(?iuU)^(?:" + "|".join(text.LINE_JUNK) + ")$"
    lines = f"filter(transform(split({welded}, {_s(chr(10))}, -1), l -> {_strip(_replaced('l', ('[ \t]+', ' ')))}), l -> length(l) > 0 AND NOT l RLIKE {_s(junk)})"
    kept = _let(lines, "ls", lambda ls: f"filter({ls}, (l, i) -> length(l) > 3 OR array_position({ls}, l) = i + 1)")
    return _strip(f"array_join({kept}, {_s(chr(10))})")


def _body(x: str) -> str:
    """Stripped text nodes of a page's body, joined by blanks."""
    kept = _replaced(x, *((rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "") for tag in html.DROPPED))
    inside = _let(kept, "k", lambda k: f"if({k} RLIKE {_s(r'(?i)<body\b')}, regexp_extract({k}, {_s(r'(?is)<body\b[^>]*>(.*?)(?:</body\s*>|$)')}, 1), {k})")
    marked = _replaced(inside, ("(?is)<!doctype[^>]*>", html.MARK), ("<!--|-->", html.MARK), ("<[^>]*>", html.MARK))
    return f"array_join(filter(transform(split(unescape_html({marked}), {_s(html.MARK)}, -1), n -> {_strip('n')}), n -> length(n) > 0), ' ')"


def _canonical(url: str) -> str:
    part = lambda n: f"regexp_extract({url}, {_s(urls._PARTS)}, {n})"
    plain = lambda pattern: f"coalesce(try_url_decode(regexp_extract(p, {_s(pattern)}, 1)), replace(regexp_extract(p, {_s(pattern)}, 1), '+', ' '))"
    coded = lambda v: f"replace(replace(url_encode({v}), '*', '%2A'), '%7E', '~')"
    pairs = f"transform(filter(split({part(4)}, '&', -1), p -> p RLIKE {_s('(?s)^[^=]*=.')}), p -> struct({plain('(?s)^([^=]*)=')} AS k, {plain('(?s)^[^=]*=(.*)$')} AS v))"
    query = f"array_join(transform(array_sort({pairs}), p -> concat({coded('p.k')}, '=', {coded('p.v')})), '&')"
    scheme, host, path = f"lower({part(1)})", f"lower({part(2)})", part(3)
    return f"concat(if({scheme} <> '', concat({scheme}, ':'), ''), if({host} <> '' OR {scheme} <> '', concat('//', {host}), ''), if({path} = '', '/', {path}), {_let(query, 'q', lambda q: f"if({q} <> '', concat('?', {q}), '')")})"


def register(spark: SparkSession) -> None:
    """clean_text, clean_html, chunk_text, canonicalize_url, url_hash and cosine in SQL.

    Python runs only below them where Spark has no function: normal forms, character references, chunking.
    """
    spark.udf.register("nfc", text.nfc)
    spark.udf.register("unescape_html", html.unescape)
    spark.udf.register("chunk_text", chunk.chunk_udf())
    dot = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    for name, args, kind, body in (
        ("clean_text", "t STRING", "STRING", _clean_text("nfc(t)")),
        ("clean_html", "h STRING", "STRING", _clean_text(f"nfc({_body('h')})")),
        ("canonicalize_url", "u STRING", "STRING", _canonical("u")),
        ("url_hash", "u STRING", "STRING", f"substr(md5(CAST(({_canonical('u')}) AS BINARY)), 1, 16)"),
        ("cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", f"{dot('a', 'b')} / sqrt({dot('a', 'a')} * {dot('b', 'b')})"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
