"""Text functions as Catalyst expressions. ``SPACE`` is white space as Python's str.isspace has it."""

from __future__ import annotations

import unicodedata
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
STRIP = f"^{SPACE}+|{SPACE}+$"

# What the cleaner replaces and removes, in order.
CHAR_REPLACEMENTS = (
    ("\u200b", ""), ("\u200c", ""), ("\u200d", ""), ("\ufeff", ""), ("\u00a0", " "), ("\u00b7", ""), ("\u2013", "-"),
    ("\u2014", "-"), ("\u2018", "'"), ("\u2019", "'"), ("\u201c", '"'), ("\u201d", '"'), ("\u2026", "..."),
)
INLINE_JUNK = (
    "<<vui lòng xem tại đây>>", "vui lòng xem tại đây", "bấm vào để xem", "bấm vào đây để xem", "xem tại đây", "TẠI ĐÂY",
    "xem chi tiết tại đây", "chi tiết xem tại", "tải về tại đây", "tải file tại đây", "download tại đây", "nhấn vào đây",
    "click vào đây", "click tại đây", "vui lòng bấm vào", "vui lòng click", "vui lòng nhấn", "xem thêm tại", "chi tiết tại",
    "tại đường link", "theo đường link", "link bên dưới", "link phía dưới", "đính kèm bên dưới", "file đính kèm bên dưới",
)
LINE_JUNK = ("TẠI ĐÂY", "tại đây", "xem tại đây", "<<[^\n]*>>", "\u00b7", r"\.", "-", r"\|", r"\d{1,2}")
JUNK_LETTERS = "[đĐ\u1ea0-\u1ef9]|(?iu:lòng)"
ZERO_WIDTH = tuple(c for c, _ in CHAR_REPLACEMENTS[:4])


@F.arrow_udf(StringType())
def nfc(text: pa.Array) -> pa.Array:
    """NFC normalisation, which Spark has no function for, and which pyarrow's utf8_normalize doesn't compose."""
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in text.to_pylist()], pa.string())


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def quoted(phrase: str) -> str:
    """A phrase as a literal pattern, in any case."""
    return "(?iu)\\Q" + phrase + "\\E"


def replace_chars(text: Column, zero_width: str = "parity") -> Column:
    """Typographic characters to plain ones.

    ``parity`` leaves zero-width characters alone but removes their UTF-8 bytes misread as Latin-1, as
    the original does; ``intent`` removes the characters themselves.
    """
    if zero_width not in ("parity", "intent"):
        raise ValueError("zero_width is 'parity' or 'intent'")
    for old, new in CHAR_REPLACEMENTS:
        if old in ZERO_WIDTH and zero_width == "parity":
            old = old.encode().decode("latin-1")
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _rare(phrase: str) -> list[str]:
    """Letters of a phrase outside ASCII, in lower case; (?iu) takes for them their upper case and nothing else."""
    return sorted({c for c in phrase.lower() if not c.isascii()})


def _has(text: Column, letters: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.contains(text, F.lit(c)) | F.contains(text, F.lit(c.upper())) for c in letters))


def remove_inline_junk(text: Column) -> Column:
    """Each phrase in turn; earlier ones may cut later, longer ones short.

    A phrase is sought in texts that have all its letters outside ASCII: removing others adds no letters.

    Every phrase has a letter of JUNK_LETTERS or the word in it; texts without any are passed over.
    """
    def less(needed: list[str], phrases: list[str], rest: Column):
        return lambda v: F.when(_has(rest, needed), reduce(lambda y, p: F.regexp_replace(y, quoted(p), ""), phrases, v)).otherwise(v)

    def cleaned(x: Column, rest: Column) -> Column:
        for needed, phrases in groupby(INLINE_JUNK, _rare):
            x = F.transform(F.array(x), less(needed, list(phrases), rest))[0]
        return x

    # each step is an array of one, so that the next reads its value instead of computing it again
    rests = lambda x: F.array(F.regexp_replace(x, r"[\x00-\x7f]+", ""))
    all_cleaned = F.transform(F.array(text), lambda x: F.transform(rests(x), lambda rest: cleaned(x, rest))[0])[0]
    return F.when(text.rlike(JUNK_LETTERS), all_cleaned).otherwise(text)


def weld(text: Column) -> Column:
    """Joins tokens that blanks tore apart: around slashes and between digits."""
    text = F.regexp_replace(text, "[ \t]+/", "/")
    text = F.regexp_replace(text, "/[ \t]+", "/")
    return F.regexp_replace(text, r"(?U)(?<=\d)[ \t]+(?=\d)", "")


def split_lines(text: Column) -> Column:
    """Stripped lines with single blanks, without empty ones."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: strip(F.regexp_replace(x, "[ \t]+", " ")))
    return F.filter(lines, lambda x: F.length(x) > 0)


def drop_junk_lines(lines: Column) -> Column:
    pattern = "(?iuU)^(?:" + "|".join(LINE_JUNK) + ")$"
    return F.filter(lines, lambda x: ~x.rlike(pattern))


def dedup_short_lines(lines: str) -> Column:
    """Of equal lines of up to three characters only the first; ``lines`` must be a column's name, so that it is computed once."""
    return F.filter(lines, lambda x, i: (F.length(x) > 3) | (F.array_position(F.col(lines), x) == i + 1))


def clean_text(df: DataFrame, text: str, into: str, zero_width: str = "parity", normalize: bool = True) -> DataFrame:
    """``df`` with the cleaned ``text`` in ``into``; null stays null.

    Steps are named columns, so that no expression is evaluated twice.
    """
    source = nfc(F.col(text)) if normalize else F.col(text)
    return (
        df.withColumn("__t0", source)
        .withColumn("__r", replace_chars(F.col("__t0"), zero_width))
        .withColumn("__t1", weld(remove_inline_junk(F.col("__r"))))
        .withColumn("__lines", drop_junk_lines(split_lines(F.col("__t1"))))
        .withColumn("__kept", dedup_short_lines("__lines"))
        .withColumn(into, strip(F.array_join("__kept", "\n")))
        .drop("__t0", "__r", "__t1", "__lines", "__kept")
    )


def slugify(text: Column, longest: int = 40) -> Column:
    """Lower-case words joined by '-', at most ``longest`` characters; 'uncategorized' if none are left."""
    word = r"\p{L}\p{N}_"
    space = SPACE[1:-1]
    kept = F.regexp_replace(strip(F.lower(text)), f"[^{word}{space}-]", "")
    slug = F.regexp_replace(F.regexp_replace(kept, f"[{space}_-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(slug, 1, longest), F.lit("")), F.lit("uncategorized"))


def format_table(rows: Column) -> Column:
    """Lines of an array of rows of cells: blanks squeezed, cells joined by ' | ', empty rows dropped."""
    cell = lambda c: strip(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " "))
    lines = F.transform(rows, lambda r: F.regexp_replace(F.array_join(F.transform(r, cell), " | "), r"^[ |]+|[ |]+$", ""))
    return F.filter(lines, lambda x: F.length(x) > 0)


def decode_bytes(data: Column) -> Column:
    """Text of bytes: UTF-8 where valid (a byte-order mark stays), else Latin-1, which always is."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.decode(data, "ISO-8859-1"))
