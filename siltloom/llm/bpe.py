"""Byte-level BPE encoding and decoding with a contiguous rank array.

A word is held as two short lists: the ids of its parts in order, and the merge rank of each
adjacent pair. The lists are scanned for the smallest rank, the right-hand part is deleted and the two
neighbouring ranks are refreshed, until no pair can merge. Words longer than ``SCAN_LIMIT`` bytes
take the same merges from a heap, so a run of a million letters stays n log n.

Null and empty texts give no tokens. The added token of the vocabulary file is matched inside texts,
as the tokenizers library does by default. Every row is independent: repeated rows, ties and extra
columns have no influence, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCAN_LIMIT = 128
#: Words kept per Python worker; the store is emptied when full, which only costs time.
CACHE_WORDS = 300_000
#: Characters of a cached word or chunk, at most; longer ones are encoded each time.
CACHE_CHARS = 64
#: Letters and numbers that Unicode 16 added to what unicodedata 15.1 knows.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


@lru_cache(maxsize=1)
def _classes() -> tuple[str, str, str]:
    """Character classes of letters, numbers and white space, as the pre-tokenizer has them."""

    def ranges(test) -> str:
        out, run = [], None
        for c in range(0x110000):
            if test(c):
                run = [c, c] if run is None else [run[0], c]
            elif run:
                out.append(run)
                run = None
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)

    kind = {c: unicodedata.category(chr(c))[0] for c in range(0x110000)}
    for k, more in (("L", NEW_LETTERS), ("N", NEW_NUMBERS)):
        kind |= {c: k for a, b in more for c in range(a, b + 1)}
    white = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    return ranges(lambda c: kind.get(c) == "L"), ranges(lambda c: kind.get(c) == "N"), ranges(white.__contains__)


def word_pattern() -> re.Pattern:
    """The byte-level pre-tokenizer's split pattern in terms of Python's re."""
    letter, number, white = _classes()
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{white}{letter}{number}]+|[{white}]+(?![^{white}])|[{white}]+")


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself where printable, else 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder of one vocabulary; ``spec`` is the text of a tokenizer file."""

    def __init__(self, spec: str):
        doc = json.loads(spec)
        letters = byte_letters()
        vocab = doc["model"]["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in doc["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        self.added = {t["content"]: t["id"] for t in doc["added_tokens"]}
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.first = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(doc["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.pattern = word_pattern()
        white = _classes()[2]
        self.odd = re.compile(f" [{white}]|[{white}] |^ | $")
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one pre-tokenized word."""
        parts = [self.first[b] for b in word]
        if len(parts) > SCAN_LIMIT:
            return self._merge_long(parts)
        merges, none = self.merges, (1 << 60, -1)
        ranks = [merges.get(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best is none or best[1] < 0:
                break
            i = ranks.index(best)
            parts[i] = best[1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = merges.get((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = merges.get((parts[i - 1], parts[i]), none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, merges = len(parts), self.merges
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], i, m[1], parts[i], parts[i + 1]) for i in range(n - 1) if (m := merges.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = new, -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (m := merges.get((parts[x], parts[y]))):
                    heapq.heappush(heap, (m[0], x, m[1], parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def _word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            got = np.asarray(self.merge(word.encode()), "<u4").tobytes()
            if len(word) <= CACHE_CHARS:
                self.words[word] = got
        return got

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens.

        Where every blank is a single space between other characters, a word never crosses a
        space except by starting with one, so the text is looked up in space-delimited chunks.
        """
        if self.odd.search(text):
            return b"".join(map(self._word, self.pattern.findall(text)))
        head, *rest = text.split(" ")
        chunks = self.chunks
        if len(chunks) >= CACHE_WORDS:
            chunks.clear()
        long = {}
        for chunk in set(rest).difference(chunks):
            (chunks if len(chunk) <= CACHE_CHARS else long)[chunk] = b"".join(map(self._word, self.pattern.findall(" " + chunk)))
        found = (lambda c: long[c] if c in long else chunks[c]) if long else chunks.__getitem__
        return b"".join([*map(self._word, self.pattern.findall(head)), *map(found, rest)])

    def encode(self, text: str | None) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.split_added is None or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(np.asarray([self.added[x]], "<u4").tobytes() if x in self.added else self._plain(x) for x in self.split_added.split(text) if x)

    def decode(self, ids: bytes) -> str:
        """Text of encoded ids; bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode(df: DataFrame, vocab_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ``ids`` (little-endian uint32 binary), ``n_tokens`` and ``decoded``.

    ``decoded`` is decoded from ``ids``. The vocabulary file is read on the driver and sent to
    the executors, its size being fixed by the vocabulary (1.5 MB) and checked.
    """
    with open(vocab_path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > 64 << 20:
        raise ValueError("vocabulary files of more than 64 MB aren't broadcast")
    shared = df.sparkSession.sparkContext.broadcast(spec)
    names = list(keep)
    source = df.select(*names, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBPE(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [bpe.encode(t) for t in part.column(len(names)).to_pylist()]
                cols = [part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([bpe.decode(x) for x in ids], pa.string())],
                    names=[*names, "ids", "n_tokens", "decoded"],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}{', ' if fields else ''}ids binary, n_tokens bigint, decoded string")


def digests(encoded: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """n_tokens and the SHA-256 of ids and of decoded text."""
    return encoded.select(*keep, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def sha256(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()
