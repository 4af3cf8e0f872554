"""Toxicity: a sparse word classifier with a counterfactual penalty.

Features of a text are its words (runs of letters, digits and non-ASCII bytes, A-Z folded) and their
beginnings of 4 to 8 bytes, by 64-bit hash, each found at all, or found repeatedly at one of two
rates (``RATES``), so that a long text isn't judged by what any long text holds. The model is a logistic regression with
non-negative weights, so clean text around an insult can't hide it, an L1 penalty, and the
counterfactual penalty: in every labelled sentence that names a group, each name is swapped for
every other of its kind and squared changes of the score are penalised. A name that merely co-occurs
with label 1 thus keeps no weight of its own. A swap changes only the counts of the two names' features,
so equal changes are counted rather than listed, and none is left out.

Fitting uses at most ``MAX_TRAIN_ROWS`` labelled ids, those with the smallest hash, and of rows that repeat
an id the one whose text has the smallest hash. The weights are found on the driver, which gets these rows' features that
enough rows of label 1 have; Spark counts those. Scoring covers whole texts. Null and empty texts score as no words do.
Rows with a null label are not learned from; with no label 1 or no label 0 every score is 0.
Repeated rows are scored alike, ties don't arise, extra columns are ignored, and an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .sampling import smallest_hashes
from .scratch import Scratch

#: Labelled rows that a model is fitted on, at most.
MAX_TRAIN_ROWS = 8000
#: A feature counts if at least three rows and this share of the rows with label 1 have it.
MIN_SUPPORT = 0.02
PREFIXES = (4, 5, 6, 7, 8)
#: Words per occurrence, at most, for each level of a feature after the first; those need two occurrences.
RATES = (250, 80)
LEVELS = 1 + len(RATES)
#: Names of groups, by kind. Within a kind any name can stand for another.
IDENTITY_TERMS = {
    "gender": "man men woman women boy boys girl girls male female homme femme hommes femmes mann frau männer frauen hombre mujer hombres mujeres".split(),
    "religion": "christian christians muslim muslims jew jews jewish hindu hindus buddhist buddhists atheist atheists catholic catholics".split(),
    "origin": "african africans asian asians european europeans american americans arab arabs mexican mexicans indian indians immigrant immigrants refugee refugees".split(),
    "colour": "black white brown".split(),
    "orientation": "gay lesbian bisexual transgender heterosexual homosexual queer straight".split(),
    "age_ability": "old young elderly disabled blind deaf".split(),
}
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
_SWAPS = {t: [x for x in kind if x != t] for kind in IDENTITY_TERMS.values() for t in kind}


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and 64-bit feature hash of every word and word beginning, and the words of each row."""
    data = words.FOLD[data]
    is_word = _LETTER[data]
    starts, ends, rows = words.spans(is_word, offsets)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    head = np.ndarray(len(data), "<u8", padded, strides=(1,))[starts] if len(data) else np.empty(0, np.uint64)
    out, of = [words.hashes(data, is_word, starts, ends)], [rows]
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts >= n)
        out.append(words.mix((head[long] & np.uint64((1 << 8 * n) - 1)) + np.uint64(n * 0x9E3779B97F4A7C1)))
        of.append(rows[long])
    return np.concatenate(of), np.concatenate(out), np.bincount(rows, minlength=len(offsets) - 1)


Bag = tuple[np.ndarray, np.ndarray]


def levels(n: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """The level, from 1 to LEVELS, that n occurrences reach among n_words words."""
    return 1 + sum((n >= 2) & (n * r >= n_words) for r in RATES)


def text_features(text: str) -> Bag:
    """Distinct feature hashes in order, and the level of each."""
    raw = np.frombuffer(text.encode(), np.uint8)
    _, found, n_words = features(raw, np.array([0, len(raw)]))
    keys, n = np.unique(found, return_counts=True)
    return keys, levels(n, n_words).astype(np.uint8)


#: Changes of a bag by a swap: feature, level from 0 and sign of each, packed; and how often each occurs.
Changes = dict[bytes, int]
_CHANGE = np.dtype([("key", "<u8"), ("level", "u1"), ("sign", "i1")])


@lru_cache(maxsize=4096)
def _name_features(name: str) -> np.ndarray:
    raw = np.frombuffer(name.encode(), np.uint8)
    return features(raw, np.array([0, len(raw)]))[1]


def counterfactuals(text: str) -> Changes:
    """What changes when, in a sentence, a name of a group is swapped for another of its kind, for all names and others."""
    out: Changes = {}
    for sentence in _SENTENCE.findall(text):
        named: dict[str, int] = {}
        for m in _WORD.findall(sentence):
            if m.lower() in _SWAPS:
                named[m] = named.get(m, 0) + 1
        if not named:
            continue
        raw = np.frombuffer(sentence.encode(), np.uint8)
        _, found, n_words = features(raw, np.array([0, len(raw)]))
        keys, n = np.unique(found, return_counts=True)
        for name, times in named.items():
            for other in _SWAPS[name.lower()]:
                less, more = _name_features(name), _name_features(other)
                touched = np.unique(np.concatenate([less, more]))
                at = np.minimum(np.searchsorted(keys, touched), len(keys) - 1)
                before = np.where(keys[at] == touched, n[at], 0)
                after = before - np.isin(touched, less) + np.isin(touched, more)
                had, has = (np.where(k > 0, levels(k, n_words[0]), 0) for k in (before, after))
                change = [(f, c, 1 if x > y else -1) for f, x, y in zip(touched, had, has) for c in range(min(x, y), max(x, y))]
                if change:
                    packed = np.array(change, _CHANGE).tobytes()
                    out[packed] = out.get(packed, 0) + times
    return out


@dataclass
class Model:
    """Active features in order, the summed weights at levels 1 to LEVELS, and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.mask = np.zeros(1 << 16, bool)
        self.mask[(self.keys >> np.uint64(48)).astype(np.int64)] = True

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        logit = np.full(len(offsets) - 1, self.bias)
        for i, j in words.blocks(offsets):
            lo, hi = offsets[i], offsets[j]
            rows, keys, n_words = features(data[lo:hi], offsets[i : j + 1] - lo)
            near = np.flatnonzero(self.mask[(keys >> np.uint64(48)).astype(np.int64)])
            if not len(near) or not len(self.keys):
                continue
            at = np.minimum(np.searchsorted(self.keys, keys[near]), len(self.keys) - 1)
            hit = self.keys[at] == keys[near]
            pairs, n = np.unique(rows[near][hit] * len(self.keys) + at[hit], return_counts=True)
            row = pairs // len(self.keys)
            logit[i:j] += np.bincount(row, self.weights[pairs % len(self.keys), levels(n, n_words[row]) - 1], j - i)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    def score(self, text: str | None) -> float:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return float(self.scores(raw, np.array([0, len(raw)]))[0])


def _columns(bags: list[Bag], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bag and column of each feature that holds; column: LEVELS * place in keys + level - 1."""
    of = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    all_keys, n = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
    at = np.minimum(np.searchsorted(keys, all_keys), len(keys) - 1)
    known = keys[at] == all_keys
    of, at, n = of[known], at[known], n[known]
    return np.concatenate([of[n > c] for c in range(LEVELS)]), np.concatenate([at[n > c] * LEVELS + c for c in range(LEVELS)])


def enough(positive: int) -> int:
    """Rows of label 1 that must have a feature, of so many."""
    return max(3, math.ceil(MIN_SUPPORT * positive))


def fit_arrays(rows: list[tuple[int, Bag]], swaps: Changes, keys: np.ndarray, l1: float = 2e-4, fairness: float = 4.0, steps: int = 800) -> Model:
    """Proximal gradient descent. rows: label and bag of features; swaps: changes of bags; keys: features that can matter, in order."""
    y = np.array([r[0] for r in rows], np.float64)
    pos, neg = y.sum(), (1 - y).sum()
    none = Model(np.empty(0, np.uint64), np.empty((0, LEVELS)), -40.0)
    if not pos or not neg:
        return none
    if not len(keys):
        return none
    of, col = _columns([r[1] for r in rows], keys)
    in_pos, total = np.bincount(col, y[of], len(keys) * LEVELS), np.bincount(col, minlength=len(keys) * LEVELS)
    # weights can't be negative, so a feature must be more common under label 1 to get any
    useful = (in_pos >= enough(int(pos))) & (in_pos / pos > 3 * (total - in_pos) / neg)
    n = int(useful.sum())
    if not n:
        return none
    slot = np.where(useful, np.cumsum(useful) - 1, -1)
    of, col = of[useful[col]], slot[col[useful[col]]]
    changes = [np.frombuffer(x, _CHANGE) for x in swaps]
    often = np.array(list(swaps.values()), np.float64)
    often *= 2 * fairness / max(often.sum(), 1)
    pair_of = np.repeat(np.arange(len(changes)), [len(x) for x in changes]).astype(np.int64)
    change = np.concatenate([*changes, np.empty(0, _CHANGE)])
    at = np.minimum(np.searchsorted(keys, change["key"]), len(keys) - 1)
    pair_col = at * LEVELS + change["level"]
    known = (keys[at] == change["key"]) & useful[pair_col]
    pair_of, pair_col, pair_sign = pair_of[known], slot[pair_col[known]], change["sign"][known].astype(np.float64)
    weight = np.where(y == 1, 0.5 / pos, 0.5 / neg)

    def slopes(z: np.ndarray, zb: float) -> tuple[np.ndarray, float]:
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, z[col], len(rows)) + zb, -40, 40)))
        r = weight * (p - y)
        g = np.bincount(col, r[of], n)
        if len(pair_of):
            d = often * np.bincount(pair_of, pair_sign * z[pair_col], len(swaps))
            g += np.bincount(pair_col, pair_sign * d[pair_of], n)
        return g, float(r.sum())

    # the largest curvature, by power iteration on a bound of the Hessian
    v, vb, curve = np.ones(n), 1.0, 1.0
    for _ in range(20):
        r = weight * 0.25 * (np.bincount(of, v[col], len(rows)) + vb)
        g, gb = np.bincount(col, r[of], n), r.sum()
        if len(pair_of):
            d = often * np.bincount(pair_of, pair_sign * v[pair_col], len(swaps))
            g += np.bincount(pair_col, pair_sign * d[pair_of], n)
        curve = float(np.sqrt((g * g).sum() + gb * gb)) or 1.0
        v, vb = g / curve, gb / curve
    step = 0.9 / curve
    w, bias, z, zb, t = np.zeros(n), -1.0, np.zeros(n), -1.0, 1.0
    for _ in range(steps):
        g, gb = slopes(z, zb)
        w1, b1 = np.maximum(z - step * (g + l1), 0), zb - step * gb
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - bias)
        w, bias, t = w1, b1, t1
    full = np.zeros(len(keys) * LEVELS)
    full[useful] = w
    full = full.reshape(-1, LEVELS).cumsum(1)
    on = full[:, -1] > 1e-3
    return Model(keys[on], full[on], float(bias))


def fit(labelled: DataFrame, text: str = "text", label: str = "label") -> Model:
    """Fit on ``labelled``, whose rows its caller chooses and bounds."""
    source = labelled.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), F.col(text).alias("t"))
    scratch = Scratch(labelled.sparkSession, "toxicity")

    def found(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([text_features(t or "")[0].view(np.int64) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["keys"])

    def bags(keys: np.ndarray):
        def run(batches):
            for batch in batches:
                out = []
                for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    k, n = text_features(t or "")
                    known = np.isin(k, keys, assume_unique=True)
                    swaps = counterfactuals(t or "")
                    out.append({"y": y, "k": k[known].tobytes(), "n": n[known].tobytes(), "swaps": [{"change": c, "n": x} for c, x in swaps.items()]})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

        return run

    schema = pa.schema([("y", pa.int32()), ("k", pa.binary()), ("n", pa.binary()), ("swaps", pa.list_(pa.struct([("change", pa.binary()), ("n", pa.int64())])))])
    with scratch.dropping():
        source = scratch.cut(source)
        # what label 1 holds decides which features can matter; of all rows only those are fetched
        positive = source.where("y = 1")
        common = positive.mapInArrow(found, "keys array<bigint>").select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= enough(positive.count()))
        keys = np.sort(common.select("key").toArrow()["key"].to_numpy().view(np.uint64))
        made = scratch.cut(source.mapInArrow(bags(keys), "y int, k binary, n binary, swaps array<struct<change: binary, n: bigint>>"))
        got = made.select("y", "k", "n").toArrow()
        swaps = made.select(F.explode("swaps").alias("s")).groupBy("s.change").agg(F.sum("s.n").alias("n")).orderBy("change").toArrow()
    rows = [(int(y), (np.frombuffer(k, np.uint64), np.frombuffer(n, np.uint8))) for y, k, n in zip(got["y"].to_pylist(), got["k"].to_pylist(), got["n"].to_pylist())]
    return fit_arrays(rows, dict(zip(swaps["change"].to_pylist(), swaps["n"].to_pylist())), keys)


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", text: str = "text", max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Texts and labels of at most ``max_rows`` labelled ids outside the held-out fold.

    The fold is crc32(id) mod 5 = 0. The ids, whose number is bounded, are broadcast to the texts.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col(key).cast("string")) % 5 != 0))
    rows = known.select(F.col(key).alias("__id"), F.col(label).cast("int").alias("__label"))
    chosen = smallest_hashes(rows, F.col("__id"), max_rows, "__id", "__label")
    texts = docs.select(F.col(key).alias("__key"), F.col(text).alias("text"))
    joined = texts.join(F.broadcast(chosen), F.col("__key") == F.col("__id"))
    one = Window.partitionBy("__id", "__label").orderBy(F.xxhash64("text"), "text")
    return joined.withColumn("__n", F.row_number().over(one)).where("__n = 1").select("text", F.col("__label").alias("label"))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``df`` with a column ``score``; a column of that name is replaced."""
    df = df.drop("score")
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)

    def run(batches):
        for batch in batches:
            data, offsets = words.column_bytes(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(data, offsets), pa.float64())], names=[*batch.schema.names, "score"])

    from pyspark.sql.types import DoubleType, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType().add("score", DoubleType()).fields]))
