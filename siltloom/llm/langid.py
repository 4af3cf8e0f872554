"""Language identification with a byte convolutional network.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes that cover it whole, the last one
aligned to the end, short texts padded with spaces. Filters of several widths slide over byte
embeddings; each filter's maximum over the window feeds a softmax. A text's probabilities are the
mean over its windows. Because a byte has one of 256 embeddings, a filter's response is a sum of
table entries, which inference looks up by byte pairs.

Training (numpy, on the driver) uses at most ``MAX_TRAIN_ROWS`` windows of labelled texts, cut as those of
the texts to be judged: half of them are drawn by hash from all windows of all texts, the other half
are one window each, anywhere in its text, of texts drawn by hash, so that short texts count too. Null texts and texts without a letter get ``und`` and score 0. Rows with a null language aren't
learned from; with no labelled text at all every text is ``und``. Equal texts get equal results,
equal probabilities go to the first language in order, extra columns are ignored, and an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .sampling import RANGE

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
#: Windows of labelled texts that a network is trained on, at most.
MAX_TRAIN_ROWS = 12000
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def windows(raw: np.ndarray) -> np.ndarray:
    """All windows of one text, A-Z folded, as rows."""
    raw = words.FOLD[raw]
    if len(raw) <= WINDOW:
        return np.concatenate([raw, np.full(WINDOW - len(raw), 32, np.uint8)])[None]
    full = raw[: len(raw) // WINDOW * WINDOW].reshape(-1, WINDOW)
    return full if len(raw) % WINDOW == 0 else np.concatenate([full, raw[None, -WINDOW:]])


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[tuple[int, list[tuple[int, np.ndarray]]]]:
        """Per width: byte offsets with tables by byte pair, or by byte for an odd last one."""
        made = []
        for k in WIDTHS:
            one = [self.embed @ self.filters[k][j] for j in range(k)]
            parts = [(j, (one[j][:, None] + one[j + 1][None]).reshape(65536, -1).astype(np.float32)) for j in range(0, k - 1, 2)]
            made.append((k, parts + ([(k - 1, one[k - 1].astype(np.float32))] if k % 2 else [])))
        return made

    def probabilities(self, x: np.ndarray, tables=None) -> np.ndarray:
        """Softmax rows of window rows."""
        tables = tables or self.tables()
        got = np.empty((len(x), len(self.langs)))
        for at in range(0, len(x), 64):
            part = x[at : at + 64]
            pair = (part[:, :-1].astype(np.int32) << 8) | part[:, 1:]
            pooled = []
            for k, parts in tables:
                n = WINDOW - k + 1
                total = None
                for j, table in parts:
                    codes = pair[:, j : j + n] if len(table) == 65536 else part[:, j : j + n]
                    rows = table.take(codes, 0)
                    total = rows if total is None else np.add(total, rows, out=total)
                pooled.append(np.maximum(total.max(1) + self.bias[k], 0))
            z = np.concatenate(pooled, 1) @ self.out + self.out_bias
            e = np.exp(z - z.max(1, keepdims=True))
            got[at : at + 64] = e / e.sum(1, keepdims=True)
        return got


def train(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 4, least_steps: int = 600, rate: float = 4e-3, seed: int = 7) -> Network:
    """Adam on cross-entropy, over ``epochs`` passes or ``least_steps`` batches of 96. x: window rows; y: indices into langs."""
    rng = np.random.default_rng(seed)
    net = Network(langs, rng.normal(0, 0.5, (256, EMBED)), {k: rng.normal(0, 1 / np.sqrt(k * EMBED), (k, EMBED, FILTERS)) for k in WIDTHS}, {k: np.zeros(FILTERS) for k in WIDTHS}, rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))), np.zeros(len(langs)))
    params = [net.embed, *net.filters.values(), *net.bias.values(), net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    balance = len(y) / np.maximum(np.bincount(y, minlength=len(langs)), 1) / len(langs)
    t = 0
    for _ in range(max(epochs, -(-least_steps * 96 // len(x)))):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 96):
            part, want = x[order[at : at + 96]], y[order[at : at + 96]]
            pooled, peaks = [], []
            for k in WIDTHS:
                n = WINDOW - k + 1
                total = sum((net.embed @ net.filters[k][j]).astype(np.float32).take(part[:, j : j + n], 0) for j in range(k))
                peak = total.argmax(1)
                pooled.append(np.take_along_axis(total, peak[:, None], 1)[:, 0] + net.bias[k])
                peaks.append(peak)
            h = np.concatenate(pooled, 1)
            z = np.maximum(h, 0) @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = p.copy()
            d[np.arange(len(want)), want] -= 1
            d *= (balance[want] / len(want))[:, None]
            g_out, g_ob = np.maximum(h, 0).T @ d, d.sum(0)
            dh = (d @ net.out.T) * (h > 0)
            g_embed, g_filters, g_bias = np.zeros_like(net.embed), [], []
            for i, k in enumerate(WIDTHS):
                dk, g = dh[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(net.filters[k])
                for j in range(k):
                    codes = np.take_along_axis(part, peaks[i] + j, 1)
                    g[j] = np.einsum("bf,bfe->ef", dk, net.embed[codes])
                    np.add.at(g_embed, codes, dk[:, :, None] * net.filters[k][j].T[None])
                g_filters.append(g)
                g_bias.append(dk.sum(0))
            t += 1
            for q, g, (m, v) in zip(params, [g_embed, *g_filters, *g_bias, g_out, g_ob], moments):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                q -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_TRAIN_ROWS) -> Network | None:
    """Train on windows of the labelled rows of ``docs`` with crc32(id) mod 4 other than 2."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.coalesce(F.crc32(F.col(key).cast("string")) % 4 != 2, F.lit(False)))
    rows = known.select(F.col(key).cast("string").alias("id"), F.col(lang).alias("lang"), F.col(text).cast("binary").alias("raw"), F.greatest(F.ceil(F.octet_length(text) / WINDOW), F.lit(1)).cast("long").alias("n"))
    texts, total = rows.agg(F.count("*"), F.sum("n")).first()
    half = max(1, max_rows // 2)
    least = lambda n: RANGE if (n or 0) <= 2 * half else int(RANGE * 2 * half / n)
    hashed = lambda *x: F.pmod(F.xxhash64("id", *x, F.lit("window")), F.lit(RANGE))
    of_all = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda w: hashed(w) < least(total)), lambda w: F.struct(F.lit(0).alias("way"), hashed(w).alias("h"), w.alias("w")))
    of_text = F.filter(F.array(F.struct(F.lit(1).alias("way"), hashed().alias("h"), F.pmod(F.xxhash64("id"), "n").alias("w"))), lambda x: x["h"] < least(texts))
    few = rows.select("id", "lang", "raw", F.explode(F.concat(of_all, of_text)).alias("x"))
    start = F.greatest(F.least(F.col("x.w") * WINDOW, F.octet_length("raw") - WINDOW), F.lit(0))
    cut = few.select("id", "lang", F.substring("raw", start.cast("int") + 1, F.lit(WINDOW)).alias("window"), "x.way", "x.h")
    order = Window.partitionBy("way").orderBy("h", "id", "lang", "window")
    chosen = cut.withColumn("k", F.row_number().over(order)).where(F.col("k") <= half).orderBy("way", "k").toArrow()
    langs = sorted(set(chosen["lang"].to_pylist()))
    if not langs:
        return None
    x = [windows(np.frombuffer(w, np.uint8))[0] for w in chosen["window"].to_pylist()]
    return train(np.array(x), np.array([langs.index(v) for v in chosen["lang"].to_pylist()]), langs)


def identify(docs: DataFrame, net: Network | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ``lang_pred`` and ``score``, the mean probability of that language."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    source = docs.select(*keep, F.col(text).alias("__text"))
    n_keep = len(keep)

    def run(batches):
        net = shared.value
        tables = net.tables() if net else None
        for batch in batches:
            data, offsets = words.column_bytes(batch.column(n_keep))
            n = batch.num_rows
            langs, scores = ["und"] * n, np.zeros(n)
            letter = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
            has = letter[offsets[1:]] > letter[offsets[:-1]]
            for i in np.flatnonzero(~has & (offsets[1:] > offsets[:-1])):
                has[i] = any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")))
            for i, j in words.blocks(offsets) if net else ():
                rows = [r for r in range(i, j) if has[r]]
                if not rows:
                    continue
                x = [windows(data[offsets[r] : offsets[r + 1]]) for r in rows]
                counts = np.array([len(w) for w in x])
                p = net.probabilities(np.concatenate(x), tables)
                mean = np.add.reduceat(p, np.cumsum(counts) - counts, axis=0) / counts[:, None]
                best = mean.argmax(1)
                for r, b, m in zip(rows, best, mean):
                    langs[r], scores[r] = net.langs[b], min(max(float(m[b]), 0.0), 1.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(n_keep)), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}, lang_pred string, score double")
