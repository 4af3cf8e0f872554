"""Text of binary files: docx by the standard library, pdf by a library if there is one, plain text by decoding.

A file that can't be read, or takes too long, has null text.
"""

from __future__ import annotations

import io
import re
import signal
import threading
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PLAIN = ("txt", "md", "csv")


def table_lines(rows: list[list[str | None]]) -> list[str]:
    """Cells squeezed and joined by ' | ', empty rows dropped."""
    lines = (" | ".join(" ".join((c or "").split()) for c in row).strip(" |") for row in rows)
    return [x for x in lines if x]


def docx_text(data: bytes) -> str:
    """All paragraphs outside tables, then all tables."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def text(el):
        return "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in el.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))

    parts = [t for p in body.findall(f"{_W}p") if (t := text(p)).strip()]
    for table in body.findall(f"{_W}tbl"):
        parts += table_lines([["\n".join(text(p) for p in cell.findall(f"{_W}p")) for cell in row.findall(f"{_W}tc")] for row in table.findall(f"{_W}tr")])
    return "\n".join(parts)


def layout_page(height: float, tables: list[tuple[float, float, list[list[str | None]]]], text_between) -> str:
    """A page's text and tables from top to bottom. tables: (top, bottom, rows); text_between(a, b): text of a band.

    Bands of up to two points between tables are skipped.
    """
    at, blocks = 0.0, []
    for top, bottom, rows in sorted(tables, key=lambda t: t[0]):
        if top - at > 2.0 and (text := (text_between(at, top) or "").strip()):
            blocks.append(text)
        blocks += table_lines(rows)
        at = max(at, bottom)
    if height - at > 2.0 and (text := (text_between(at, height) or "").strip()):
        blocks.append(text)
    return "\n".join(blocks)


def pdf_text(data: bytes) -> str | None:
    """Pages joined by blank lines, blank ones dropped; None where no pdf library is installed."""
    try:
        import pdfplumber
    except ImportError:
        return None
    pages = []
    with pdfplumber.open(io.BytesIO(data)) as pdf:
        for page in pdf.pages:
            tables = [(t.bbox[1], t.bbox[3], t.extract()) for t in page.find_tables()]
            between = lambda a, b, page=page: page.crop((0, a, page.width, b)).extract_text()
            text = layout_page(page.height, tables, between) if tables else (page.extract_text() or "")
            if text.strip():
                pages.append(text)
    return "\n\n".join(pages)


def extract(name: str | None, data: bytes | None) -> str | None:
    """Text by file suffix; None for other kinds and for files that can't be read."""
    if name is None or data is None:
        return None
    suffix = (re.search(r"\.([^.]+)$", name.lower()) or ["", ""])[1]
    try:
        if suffix == "pdf":
            return pdf_text(data)
        if suffix == "docx":
            return docx_text(data)
        if suffix in PLAIN:
            return data.decode("utf-8", "ignore")
    except Exception:  # noqa: BLE001  an unreadable file is one without text
        return None
    return None


def within(seconds: int, call, *args):
    """call(*args), or None once the time is up. Needs the worker's main thread, else there is no limit."""
    if threading.current_thread() is not threading.main_thread() or not seconds:
        return call(*args)

    def stop(*_):
        raise TimeoutError

    old = signal.signal(signal.SIGALRM, stop)
    signal.alarm(seconds)
    try:
        return call(*args)
    except TimeoutError:
        return None
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, old)


def extract_udf(timeout: int = 0):
    """(file name, bytes) columns to text."""

    @F.arrow_udf("string")
    def text_of(name: pa.Array, data: pa.Array) -> pa.Array:
        return pa.array([within(timeout, extract, n, d) for n, d in zip(name.to_pylist(), data.to_pylist())], pa.string())

    return text_of
