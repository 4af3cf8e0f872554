"""What reaches outside: fetching, embedding, reranking, generating. Each has a deterministic offline stand-in."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETRY_STATUSES = (429, 500, 502, 503, 504)
Fetch = Callable[[str], tuple[int, bytes]]


def http_fetch(timeout: int = 20) -> Fetch:
    """A fetcher over the standard library: status and body."""

    def fetch(url: str) -> tuple[int, bytes]:
        import urllib.error
        import urllib.request

        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, b""

    return fetch


def numbered_site(url: str) -> tuple[int, bytes]:
    """Offline site: what it answers hangs on the number that ends a URL's name."""
    n = int(url.rsplit("-", 1)[1].split(".")[0])
    if n % 4 == 3:
        raise OSError("down")
    return ((200, b"%PDF" + b"x" * (2000 + n % 10)), (404, b""), (200, b"<html>" + b"x" * 2000))[n % 4]


def with_retry(fetch: Fetch, attempts: int = 3, backoff: float = 2.0, sleep=time.sleep) -> Fetch:
    """Tries again on connection errors and retryable statuses, waiting twice as long each time."""

    def tried(url: str) -> tuple[int, bytes]:
        for n in range(attempts):
            last = n == attempts - 1
            try:
                status, body = fetch(url)
            except OSError:
                if last:
                    raise
            else:
                if last or status not in RETRY_STATUSES:
                    return status, body
            sleep(backoff * 2**n)
        raise ValueError("attempts must be positive")

    return tried


def fetch_pages(urls: DataFrame, fetch: Fetch, url: str = "url", delay: float = 0.0) -> DataFrame:
    """url, status, body and error per URL; a failure is a row with an error, not a failed job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for u in batch.column(0).to_pylist():
                try:
                    status, body = fetch(u)
                    rows.append({"url": u, "status": status, "body": body if status < 400 else None, "error": None if status < 400 else f"HTTP {status}"})
                except Exception as e:  # noqa: BLE001  recorded with the row
                    rows.append({"url": u, "status": None, "body": None, "error": str(e)})
                if delay:
                    time.sleep(delay)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("url", pa.string()), ("status", pa.int32()), ("body", pa.binary()), ("error", pa.string())])
    return urls.select(F.col(url).alias("url")).mapInArrow(run, "url string, status int, body binary, error string")


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Words hashed with a sign to ``dim`` places, scaled to length one; the same on every machine."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


def embed(df: DataFrame, text: str, embedder: Embedder, into: str = "embedding", batch: int = 16) -> DataFrame:
    """``df`` with vectors of ``text``, asked for ``batch`` texts at a time."""

    @F.arrow_udf("array<float>")
    def vectors(texts: pa.Array) -> pa.Array:
        got = []
        values = [t or "" for t in texts.to_pylist()]
        for at in range(0, len(values), batch):
            got += embedder.embed(values[at : at + batch]).tolist()
        return pa.array(got, pa.list_(pa.float32()))

    return df.withColumn(into, vectors(F.col(text)))


def overlap_score(question: Column, text: Column) -> Column:
    """Offline reranker: the share of the question's distinct words that the text has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    asked = words(question)
    return F.size(F.array_intersect(asked, words(text))).cast("double") / F.greatest(F.size(asked), F.lit(1))


def extractive_answer(context: Column) -> Column:
    """Offline generator: the first numbered source's text."""
    return F.regexp_extract(context, r"(?s)^\[1\][^\n]*\n(.*?)(?:\n\n---\n\n|$)", 1)
