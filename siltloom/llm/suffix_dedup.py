"""Removal of repeated byte strings by distributed prefix doubling over sampled suffixes.

A byte goes if some string of ``LENGTH`` bytes covers it that also starts in a document with a smaller
id. Spark ranks suffixes by their first bytes, then sorts pairs of (rank, what stands at a growing
offset) and ranks them anew; a suffix whose rank is unique drops out, and so does one whose rank
repeats past the threshold, since its answer is known.

* Sampling. Every window of LENGTH bytes is stood for by the least hashed ``GRAM``-byte prefix in it
  (leftmost on ties), its anchor. Equal windows have equal anchors at equal offsets, so a repeat can
  only hide where anchors repeat. About one position in 18 is an anchor; only anchors are ranked.
* Partners. The position h bytes on is seldom an anchor and so has no rank of Spark's. Its name, a 64-bit
  hash of the bytes there, is made where the text is and takes the rank's place in the pair.

Rounds, each on what the one before left; pairs are written and sorted partner first, as names differ
more than ranks:

1. (16 bytes) at every anchor. Unique anchors drop out.
2. (rank, name of up to 34 bytes before and 34 bytes after): all that the anchor's windows can cover.
   If the pair is in an earlier document, all these windows go and the anchor is past the threshold.
3. (rank, 17 bytes before) and (rank, 17 bytes after): 33 bytes, one of which every window holds.
4. (rank of the 33 bytes, name of the window): 50 bytes, the threshold. Windows of an earlier document go.

Sorting. A round sorts its pairs by (pair, document) over slots whose borders are quantiles of a sample
of documents, so a pair that repeats very often spreads over several slots. A rank is the place of the
first row of its pair in the order. A pair that is a border has rows in several slots; there are no more of
those than slots, and their parts are summed afterwards. Borders decide only where rows go.

Texts are laid out once by id in a bucketed table, read in pieces of ``PIECE`` bytes. Memory of a task
grows with its longest text by the text itself and its removed runs only.

Null texts count as empty. Documents with a null id neither remove nor lose anything. Rows that
repeat an id never remove from each other. Equal windows inside one document don't count. Texts of
any length are taken whole. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .scratch import Scratch

LENGTH, GRAM = 50, 16
SPREAD = LENGTH - GRAM  # an anchor stands at most this far into its window
HALF = 17
SUB = 1 << 40  # rows that repeat an id are told apart above the position
#: Bytes of text, and marks, that are worked on at once. Positions within a piece take PLACE_BITS bits.
PIECE, MARKS, PLACE_BITS = 1 << 20, 1 << 16, 24
#: Sampled rows for each border between slots.
PER_BORDER = 200
_FACTORS = [np.uint64(int(x) | 1) for x in np.random.default_rng(5).integers(0, 2**63, 16)]
_BYTES = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
_STEPS = ((2, 1), (4, 2), (8, 4), (16, 8), (17, 16), (32, 16), (50, 32))


def doubled(data: np.ndarray, most: int = LENGTH) -> dict[int, np.ndarray]:
    """Names of the first 1, 2, 4, 8, 16, 17, 32 and 50 bytes, up to ``most``, at every position that has so many."""
    r = {1: _BYTES[data]}
    for i, (new, left) in enumerate(_STEPS):
        if new > most:
            break
        right = new - left
        n = max(len(data) - new + 1, 0)
        if right in r:
            r[new] = r[left][:n] * _FACTORS[i] + r[right][left : left + n]
        else:  # 18 bytes as 16 and the last 16 of them
            r[new] = r[left][:n] * _FACTORS[i] + words.mix(r[16][left : left + n] + r[16][left + right - 16 : left + right - 16 + n] * _FACTORS[i + 1])
    return r


def anchors_of_windows(names: np.ndarray) -> np.ndarray:
    """Position of the anchor of each window of a piece, as if the piece were one text."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    w = (words.mix(names) & ~low) | np.arange(len(names), dtype=np.uint64)
    size, width = 1, SPREAD + 1
    while size * 2 <= width:
        w = np.minimum(w[:-size], w[size:])
        size *= 2
    if size < width:
        w = np.minimum(w[: len(w) - (width - size)], w[width - size :])
    return (w & low).astype(np.int64)


def _windows(offsets: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows that stay in one text."""
    edge = np.zeros(n + 1, np.int64)
    long = np.flatnonzero(np.diff(offsets) >= LENGTH)
    np.add.at(edge, offsets[long], 1)
    np.add.at(edge, offsets[long + 1] - LENGTH + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: max(n - LENGTH + 1, 0)] > 0)


def _pieces(batch: pa.RecordBatch, text: int):
    """First row, bytes, offsets and place in the text: texts together up to PIECE bytes, or a part of a longer one.

    Parts overlap by LENGTH - 1 bytes, so that each window is in one of them.
    """
    data, offsets = words.column_bytes(batch.column(text))
    for i, j in words.blocks(offsets, PIECE):
        start, end = int(offsets[i]), int(offsets[j])
        if end - start <= PIECE:
            yield i, data[start:end], offsets[i : j + 1] - start, 0
            continue
        for at in range(start, max(end - LENGTH + 1, start + 1), PIECE):
            part = data[at : min(at + PIECE + LENGTH - 1, end)]
            yield i, part, np.array([0, len(part)]), at - start


Borders = list[tuple[int, ...]]


def slots(columns: list[np.ndarray], borders: Borders) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each row, and whether all but its last column equal those of a border; both in the order of the columns."""
    n = len(columns[0])
    if not borders:
        return np.zeros(n, np.int32), np.zeros(n, bool)
    code, marks, same = np.zeros(n, np.int64), np.zeros(len(borders), np.int64), np.zeros(n, bool)
    for k, x in enumerate(columns):
        if k == len(columns) - 1:
            seen = np.unique(marks)
            same = seen[np.minimum(np.searchsorted(seen, code), len(seen) - 1)] == code
        y = np.array([b[k] for b in borders], np.int64)
        steps = np.unique(y)
        at = np.searchsorted(steps, x)
        # of up to three columns: fits 64 bits with a million borders
        code = code * (2 * len(steps) + 1) + 2 * at + (steps[np.minimum(at, len(steps) - 1)] == x)
        marks = marks * (2 * len(steps) + 1) + 2 * np.searchsorted(steps, y) + 1
    return np.searchsorted(marks, code, "right").astype(np.int32), same


def _batch(borders: Borders, keys: int, **columns: np.ndarray) -> pa.RecordBatch:
    """A batch of the columns, of which the first ``keys`` and ``doc`` make the order, with slot and edge."""
    arrays = {k: v.view(np.int64) if v.dtype == np.uint64 else v for k, v in columns.items()}
    slot, edge = slots([*list(arrays.values())[:keys], arrays["doc"]], borders)
    out = [x if isinstance(x, pa.Array) else pa.array(x) for x in (*arrays.values(), slot, edge)]
    return pa.RecordBatch.from_arrays(out, names=[*arrays, "slot", "edge"])


def _anchor_rows(borders: Borders):
    """name, doc, at of each anchor."""

    def run(batches):
        for batch in batches:
            docs, subs = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            for i, part, off, base in _pieces(batch, 2):
                own = _windows(off, len(part))
                if not len(own):
                    continue
                names = doubled(part, GRAM)[GRAM]
                of = anchors_of_windows(names)[own]
                a = of[np.concatenate([[True], of[1:] != of[:-1]])]
                row = np.searchsorted(off, a, "right") - 1
                yield _batch(borders, 1, name=words.mix(names[a]), doc=docs[i + row], at=a - off[row] + base + subs[i + row] * SUB)

    return run


def _marked(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position and rank of the marks that a list column gives each row, sorted."""
    lists = batch.column(column)
    n = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)
    n = np.where(lists.is_valid().to_numpy(zero_copy_only=False), n, 0)
    row = np.repeat(np.arange(len(lists)), n)
    at, rank = (lists.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("at", "rank"))
    mine = at // SUB == batch.column(1).to_numpy()[row]
    row, pos, rank = row[mine], at[mine] % SUB, rank[mine]
    order = np.lexsort((pos, row))
    return row[order], pos[order], rank[order]


def _packed(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(F.col("doc").alias(f"{name}_doc")).agg(F.collect_list(F.struct("at", "rank")).alias(name))


class _Regions:
    """The bytes around a block's marks, as texts of their own: all that windows with those anchors can cover."""

    def __init__(self, part: np.ndarray, off: np.ndarray, r: np.ndarray, a: np.ndarray):
        lo, hi = np.maximum(a - SPREAD, off[r]), np.minimum(a + LENGTH, off[r + 1])
        new = np.concatenate([[True], lo[1:] >= np.maximum.accumulate(hi)[:-1]])
        first = np.flatnonzero(new)
        start, end = lo[first], np.maximum.reduceat(hi, first)
        self.offsets = np.concatenate([[0], np.cumsum(end - start)])
        self.shift = start - self.offsets[:-1]
        self.source = np.arange(self.offsets[-1]) + np.repeat(self.shift, end - start)
        self.data = part[self.source]
        self.of = np.cumsum(new) - 1  # region of each mark
        self.a, self.lo, self.hi = a - self.shift[self.of], lo - self.shift[self.of], hi - self.shift[self.of]


def _each_block(batch: pa.RecordBatch, marks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """First row, bytes, offsets, and the marks in the block: rows, places, and a rank for each kind (-1: not of that kind)."""
    data, offsets = words.column_bytes(batch.column(2))
    for i, j in words.blocks(offsets, PIECE):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        here = []
        for row, pos, rank in marks:
            x, y = np.searchsorted(row, [i, j])
            here.append((off[row[x:y] - i] + pos[x:y], rank[x:y]))
        a = np.unique(np.concatenate([m[0] for m in here]))
        ranks = np.full((len(here), len(a)), -1, np.int64)
        for k, (places, rank) in enumerate(here):
            ranks[k, np.searchsorted(a, places)] = rank
        r = np.searchsorted(off, a, "right") - 1
        for x in range(0, len(a), MARKS):
            yield i, part, off, r[x : x + MARKS], a[x : x + MARKS], ranks[:, x : x + MARKS]


def _context_rows(borders: Borders):
    """(rank, context) of each marked anchor, with names of its left and right 17 bytes (null where its windows can't hold them)."""

    def run(batches):
        for batch in batches:
            docs, subs = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            for i, part, off, r, a, ranks in _each_block(batch, [_marked(batch, 3)]):
                x = _Regions(part, off, r, a)
                names = doubled(x.data)
                last = x.hi - LENGTH  # 50 bytes from lo and the last 50 bytes hold the context
                shape = words.mix(((x.a - x.lo) * 256 + (last - x.lo)).astype(np.uint64))
                context = words.mix(names[50][x.lo] * words.BASE + names[50][last] + shape)
                side = [words.mix(names[HALF][np.clip(p, 0, len(names[HALF]) - 1)] + np.uint64(k)).view(np.int64) for k, p in enumerate((x.a - HALF, x.a + GRAM))]
                left, right = pa.array(side[0], mask=x.a - HALF < x.lo), pa.array(side[1], mask=x.a + GRAM + HALF > x.hi)
                batch_of = _batch(borders, 2, context=context, old=ranks[0], doc=docs[i + r], at=a - off[r] + subs[i + r] * SUB)
                yield pa.RecordBatch.from_arrays([*batch_of.columns, left, right], names=[*batch_of.schema.names, "left", "right"])

    return run


def _side_rows(borders: Borders):
    """(rank, name of a side) of each anchor that isn't settled."""

    def run(batches):
        for batch in batches:
            x = {n: batch.column(n) for n in ("old", "doc", "at", "left", "right")}
            for side in ("left", "right"):
                has = x[side].is_valid().to_numpy(zero_copy_only=False)
                if has.any():
                    rank, doc, at, name = (x[n].fill_null(0).to_numpy(zero_copy_only=False)[has] for n in ("old", "doc", "at", side))
                    yield _batch(borders, 2, name=name, old=rank, doc=doc, at=at, is_left=np.full(len(at), side == "left"))

    return run


def _window_rows(borders: Borders):
    """(rank of its side, name) of each window: the left 33 bytes' rank if it holds them, else the right ones'."""

    def run(batches):
        for batch in batches:
            docs, subs = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            for i, part, off, r, a, ranks in _each_block(batch, [_marked(batch, 3), _marked(batch, 4)]):
                x = _Regions(part, off, r, a)
                names = doubled(x.data)
                side = np.full((2, len(x.data)), -1, np.int64)
                side[:, x.a] = ranks
                own = _windows(x.offsets, len(x.data))
                of = anchors_of_windows(names[GRAM])[own]
                rank = np.where(of - own >= HALF, side[0, of], side[1, of])
                p, rank = own[rank >= 0], rank[rank >= 0]
                place = x.source[p]
                row = np.searchsorted(off, place, "right") - 1
                yield _batch(borders, 2, name=words.mix(names[50][p]), old=rank, doc=docs[i + row], at=place - off[row] + subs[i + row] * SUB)

    return run


def _results(batches):
    """Removed runs and what is left of each text: settled anchors (column 3), single windows (column 4)."""
    for batch in batches:
        data, offsets = words.column_bytes(batch.column(2))
        (a_row, a, _), (w_row, w, _) = _marked(batch, 3), _marked(batch, 4)
        rows = np.arange(batch.num_rows + 1)
        ends = np.searchsorted(a_row, rows), np.searchsorted(w_row, rows)
        removed, spans, shas, where = [], [], [], []
        for r in range(batch.num_rows):
            raw = data[offsets[r] : offsets[r + 1]]
            around, single = a[ends[0][r] : ends[0][r + 1]], w[ends[1][r] : ends[1][r + 1]]
            start = np.concatenate([np.maximum(around - SPREAD, 0), single])
            stop = np.concatenate([np.minimum(around + LENGTH, len(raw)), single + LENGTH])
            order = np.argsort(start, kind="stable")
            start, stop = start[order], np.maximum.accumulate(stop[order])
            if len(start):
                first = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]]))
                start, stop = start[first], np.maximum.reduceat(stop, first)
            digest, at = hashlib.sha256(), 0
            for x, y in zip(start.tolist(), stop.tolist()):
                digest.update(raw[at:x])
                at = y
            digest.update(raw[at:])
            removed.append(int((stop - start).sum()))
            spans.append(len(start))
            where.append([{"start": x, "end": y} for x, y in zip(start.tolist(), stop.tolist())])
            shas.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas), pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
        )


class _Sorter:
    """Rounds of sorting and ranking over slots; ``sampled`` and ``one_in`` fix what borders are drawn from."""

    def __init__(self, scratch: Scratch, n_slots: int, n_bytes: int):
        self.scratch, self.n = scratch, n_slots
        share = min(1.0, PER_BORDER * n_slots * (SPREAD + 2) / 2 / max(n_bytes, 1))  # of an anchor in about 18 bytes
        docs = min(1.0, 64 * share)
        self.sampled = lambda doc: F.pmod(F.xxhash64(doc, F.lit("sample")), F.lit(1 << 20)) < int(docs * (1 << 20)) + 1
        self.one_in = max(1, round(docs / share))

    def borders(self, source: DataFrame, rows: Callable, shape: str, doc: str, order: list[str]) -> Borders:
        """Up to n - 1 borders, quantiles of a sample of about PER_BORDER rows each."""
        made = source.where(self.sampled(doc)).mapInArrow(rows([]), shape)
        drawn = made.where(F.pmod(F.xxhash64(*order, "at"), F.lit(self.one_in)) == 0).select(*order).collect()
        drawn = sorted(tuple(r) for r in drawn)
        return sorted({drawn[k * len(drawn) // self.n] for k in range(1, self.n)}) if drawn else []

    def ranked(self, source: DataFrame, rows: Callable, shape: str, doc: str, keys: list[str], hit: str, ranks: bool = True, settle: tuple[str, ...] | None = None) -> DataFrame:
        """The rows whose pair fulfils ``hit``, said of doc, lo and hi, the least and greatest doc of the pair; with new_rank.

        With ``settle``, all rows are left, beside the answer as ``hit``; the columns named then go where it is true.
        """
        shape += ", slot int, edge boolean" if "slot" not in shape else ""
        borders = self.borders(source, rows, shape, doc, [*keys, "doc"])
        group = Window.partitionBy(*keys, "slot")  # in this order, so that rows are sorted by a name first
        placed = source.mapInArrow(rows(borders), shape).repartitionById(self.n, "slot").sortWithinPartitions(*keys, "slot").withColumn("place", F.monotonically_increasing_id())
        placed = placed.withColumns({"new_rank": F.min("place").over(group), "lo": F.min("doc").over(group), "hi": F.max("doc").over(group)})
        placed = placed.withColumn("hit", F.expr(hit))
        own = [c for c in placed.columns if c in (settle or ()) or c not in (*keys, "slot", "place", "new_rank", "lo", "hi")]
        gone = F.col("hit") & ~F.col("edge")
        kept = [F.when(~gone, F.col(c)).alias(c) if c in (settle or ()) else F.col(c) for c in own]
        rank = ["new_rank"] if ranks else []
        # pairs that aren't borders have their answer; of the others, each slot has its part
        part = [F.when(F.col("edge"), F.col(c)).alias(f"{c}_") for c in (*keys, "lo", "hi")]
        written = self.scratch.cut(placed.where("true" if settle is not None else "edge or hit").select(*kept, *rank, *part))
        # no more border pairs than slots
        names = [f"{k}_" for k in keys]
        sums = written.where("edge").groupBy(*(F.col(c).alias(f"{c}2") for c in names)).agg(F.min("lo_").alias("lo"), F.max("hi_").alias("hi"), *(F.min(c).alias("head") for c in rank))
        whole = written.join(F.broadcast(sums), [F.col("edge"), *(F.col(c) == F.col(f"{c}2") for c in names)], "left")
        whole = whole.withColumns({"hit": F.when(F.col("edge"), F.expr(hit)).otherwise(F.col("hit"))} | {c: F.coalesce("head", c) for c in rank})
        return whole.where("true" if settle is not None else "hit").select(*own, *rank)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed runs (byte offsets, ends exclusive)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    laid = f"siltloom_suffix_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    again = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    rows = rows.repartition(n, "doc_id").withColumn("sub", F.when(F.col("doc_id").isNull(), 0).otherwise(F.row_number().over(again) - 1).cast("int"))
    with scratch.dropping(laid), scratch.batches(512):
        with scratch.swept():
            rows.select("doc_id", "sub", "text").write.bucketBy(n, "doc_id").option("compression", "zstd").saveAsTable(laid)
        table = spark.table(laid)
        known = table.where("doc_id is not null")
        sorter = _Sorter(scratch, n, known.agg(F.sum(F.octet_length("text"))).first()[0] or 0)

        def marked(*marks: DataFrame, every: bool = False) -> DataFrame:
            """The texts, beside the table's buckets, with lists of marks (doc, at, rank)."""
            out = table
            for i, m in enumerate(marks):
                out = out.join(_packed(m, f"m{i}"), F.col("doc_id") == F.col(f"m{i}_doc"), "left")
            some = " or ".join(f"m{i} is not null" for i in range(len(marks)))
            return out.where("true" if every else some).select("doc_id", "sub", "text", *(f"m{i}" for i in range(len(marks))))

        shape = "name bigint, doc bigint, at bigint"
        alike = sorter.ranked(known, _anchor_rows, shape, "doc_id", ["name"], "lo < hi").select("doc", "at", F.col("new_rank").alias("rank"))

        shape = "context bigint, old bigint, doc bigint, at bigint, slot int, edge boolean, left bigint, right bigint"
        contexts = sorter.ranked(marked(alike), _context_rows, shape, "doc_id", ["context", "old"], "lo < doc", ranks=False, settle=("old", "left", "right"))
        settled = contexts.where("hit").select("doc", "at", F.lit(0).cast("bigint").alias("rank"))

        shape = "name bigint, old bigint, doc bigint, at bigint, is_left boolean"
        with scratch.batches(1 << 16):
            sides = sorter.ranked(contexts.where("not hit"), _side_rows, shape, "doc", ["name", "old"], "lo < hi")
        sides = sides.select("doc", "at", F.col("new_rank").alias("rank"), "is_left")

        shape = "name bigint, old bigint, doc bigint, at bigint"
        windows = marked(sides.where("is_left").drop("is_left"), sides.where("not is_left").drop("is_left"))
        single = sorter.ranked(windows, _window_rows, shape, "doc_id", ["name", "old"], "lo < doc", ranks=False).select("doc", "at", F.lit(0).cast("bigint").alias("rank"))

        out = marked(settled, single, every=True).mapInArrow(_results, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, removed array<struct<start: bigint, end: bigint>>")
        return scratch.keep(out)


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple[int, int, int, int, str]]:
    """The definition, for tests."""
    first: dict[bytes, int] = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raws:
        if i is not None:
            for p in range(len(b) - length + 1):
                s = b[p : p + length]
                if s not in first or i < first[s]:
                    first[s] = i
    out = []
    for i, b in raws:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if i is not None and first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out
