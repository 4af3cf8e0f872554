"""Recursive character splitting with overlap."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Separators from coarse to fine, and sizes in characters.
SEPARATORS = ("\n## ", "\n### ", "\n\n", "\n", ". ", " ")
CHUNK_SIZE, CHUNK_OVERLAP = 1000, 120


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Consecutive pieces packed into chunks of up to ``size``, each starting with up to ``overlap`` of the one before."""
    out: list[str] = []
    first = held = 0  # pieces[first:i] are in the buffer, held characters together
    for i, piece in enumerate(pieces):
        n = len(piece)
        if held + n > size and i > first:
            chunk = "".join(pieces[first:i]).strip()
            if chunk:
                out.append(chunk)
            while held > overlap or (held + n > size and held > 0):
                held -= len(pieces[first])
                first += 1
        held += n
    chunk = "".join(pieces[first:]).strip()
    return [*out, chunk] if chunk else out


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of a text. A piece without any separator stays whole, however long it is."""
    level = next((k for k, s in enumerate(separators) if s in text), len(separators) - 1)
    mark, finer = separators[level], separators[level + 1 :]
    head, *rest = text.split(mark)
    out: list[str] = []
    small: list[str] = []
    for piece in filter(None, [head, *(mark + x for x in rest)]):
        if len(piece) < size:
            small.append(piece)
            continue
        out += _merge(small, size, overlap)
        small = []
        out += split_text(piece, size, overlap, finer) if finer else [piece]
    return out + _merge(small, size, overlap)


def chunk_udf(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS):
    if not separators or overlap > size:
        raise ValueError("chunking needs a separator, and an overlap of at most the size")

    @F.arrow_udf("array<string>")
    def chunks(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else split_text(t, size, overlap, separators) for t in text.to_pylist()], pa.list_(pa.string()))

    return chunks


def explode_chunks(docs: DataFrame, text: str = "content", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """A row per chunk: the columns of ``docs`` without ``text``, with chunk_pos (from 0) and chunk."""
    others = [c for c in docs.columns if c != text]
    return docs.withColumn("__chunks", chunk_udf(size, overlap)(F.col(text))).select(*others, F.posexplode("__chunks").alias("chunk_pos", "chunk"))
