"""Quality rules: compression bands.

zstandard's ratio (bytes in per byte out, level 3) of the whole text and of fixed chunks of
``CHUNK`` bytes must lie in a band that depends on length: repetitive text compresses too well,
random text too badly. Chunks cover a longer text whole, the last one aligned to its end.
A text is rejected if its whole ratio leaves its band, or if more than ``BAD_CHUNKS`` of its chunks
leave theirs. Texts of any length are read whole.

Beside the verdict come the base measures: counts of words, characters in words, symbols, repeated
lines and words in repeated five-word windows. Null and empty texts have no words and fail the base
rule. Repeated rows are judged alike, ties don't arise, extra columns are ignored, and an empty
table gives an empty result. Windows are compared by 64-bit hash within one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

#: Bytes up to which a band holds, with its lowest and highest ratio. Headers of the format weigh on
#: short texts, and matches at growing distance lift the ratio of long ones, hence the bands by length.
BANDS = ((64, 0.0, 1.6), (256, 0.5, 2.2), (1024, 1.1, 2.6), (4096, 1.3, 3.0), (16384, 1.45, 3.4), (65536, 1.5, 3.8), (1 << 62, 1.5, 4.5))
CHUNK = 4096
CHUNK_BAND = (1.3, 3.2)
BAD_CHUNKS = 0.25
LEVEL = 3
MIN_WORDS, MAX_REPEAT_PERCENT, SHINGLE = 10, 20, 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def ratio_verdict(raw: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Whole ratio, share of chunks outside their band, and whether both rules hold."""
    if not raw:
        return 1.0, 0.0, True
    ratio = len(raw) / len(packer.compress(raw))
    low, high = next((a, b) for n, a, b in BANDS if len(raw) <= n)
    bad = full = 0
    if len(raw) > CHUNK:
        for at in (*range(0, len(raw) - CHUNK, CHUNK), len(raw) - CHUNK):
            r = CHUNK / len(packer.compress(raw[at : at + CHUNK]))
            full += 1
            bad += not CHUNK_BAND[0] <= r <= CHUNK_BAND[1]
    share = bad / full if full else 0.0
    return ratio, share, low <= ratio <= high and share <= BAD_CHUNKS


def repeated_words(keys: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Per row, the words that lie in a window of SHINGLE words found twice or more in that row."""
    n = len(keys) - SHINGLE + 1
    if n <= 0:
        return np.zeros(n_rows, np.int64)
    own = np.flatnonzero(rows[:n] == rows[SHINGLE - 1 :])
    window = words.mix(rows[own].astype(np.uint64))
    for k in range(SHINGLE):
        window = words.mix(window * words.BASE + keys[own + k])
    order = np.argsort(window)
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(keys) + 1, np.int64)
    np.add.at(edge, own[twice], 1)
    np.add.at(edge, own[twice] + SHINGLE, -1)
    return np.bincount(rows[np.cumsum(edge[:-1]) > 0], minlength=n_rows)


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Base measures of each row."""
    n = len(offsets) - 1
    got = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for i, j in words.blocks(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        is_word = ~words.SPACE[part]
        starts, ends, rows = words.spans(is_word, off)
        count = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[off])
        got["n_words"][i:j] = np.bincount(rows, minlength=j - i)
        got["word_chars"][i:j] = count(is_word & ((part & 0xC0) != 0x80))
        got["n_symbols"][i:j] = count(_SYMBOL[part])
        got["n_repeat_words"][i:j] = repeated_words(words.hashes(part, is_word, starts, ends), rows, j - i)
        raw = part.tobytes()
        for k in range(j - i):
            text = raw[off[k] : off[k + 1]]
            if b"\n" in text:
                lines = [x for x in text.split(b"\n") if x and not x.isspace()]
                got["n_dup_lines"][i + k] = len(lines) - len(set(lines))
    return got


def assess(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, the base measures, ``ratio``, ``bad_chunks``, ``base_failed`` and ``kept``."""
    source = docs.select(*keep, F.col(text).alias("__text"))
    n_keep = len(keep)
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            data, offsets = words.column_bytes(batch.column(n_keep))
            got = measure(data, offsets)
            raw = data.tobytes()
            verdicts = [ratio_verdict(raw[a:b], packer) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT_PERCENT * got["n_words"])
            kept = ~failed & np.array([v[2] for v in verdicts], bool)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(n_keep)), *(pa.array(got[m]) for m in measures), pa.array(failed), pa.array(kept), pa.array([v[0] for v in verdicts], pa.float64()), pa.array([v[1] for v in verdicts], pa.float64())],
                names=[*keep, *measures, "base_failed", "kept", "ratio", "bad_chunks"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}, {', '.join(f'{m} bigint' for m in measures)}, base_failed boolean, kept boolean, ratio double, bad_chunks double")
