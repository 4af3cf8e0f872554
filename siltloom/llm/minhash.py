"""Near-duplicate classes by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all signature coordinates: the first shuffles a text's shingles over a circle of
``CIRCLE`` places, the second gives every place a value, and coordinate k is the least value that the
shingles see when the second is shifted by k places. The K values of a shingle thus stand next to
each other, and a signature is a minimum over contiguous rows. Bands of a signature propose; links
are confirmed on the full sets of 64-bit shingle hashes.

Texts of equal sets are one class, represented by its smallest id, so copies cost nothing further.
Within a band's group pairs aren't listed. Every member meets the group's smallest id first. Texts of
groups that still span several components are then indexed by the shingles in their prefix, the
rarest ones, of which two similar sets must share one early enough for the rest of both to hold the
overlap asked for. In an index entry, pivots drawn by hash, sixteen times as many each round,
meet members of other components only, until all have been pivots, so no proposed link is lost:
a large group of near copies is connected after a few pivots, and texts with too many edits of
their own, which are rare, meet no one. Entries are split by length, as texts of one length class can
only be similar to those of the next, and a node that is in many pairs has its set sent to as many
tasks as its pairs need (``SHARE`` for each). At the similarity asked for, the bands miss a pair with a
chance of 6e-11 (85 %) or 5e-8 (80 %).

Null and empty texts, and texts without words, have an empty set and link with nothing; so do rows
with a null id. Texts with fewer words than a shingle count as one. Rows that repeat an id are one
node, with the links of all their texts. Texts of any length are taken whole. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .scratch import Scratch

CIRCLE = 1 << 20
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: Pivots of an index entry in its first round, and by how much each further round has more.
PIVOTS, GROWTH = 8, 16
#: Pairs of one node that meet its set in one task, about.
SHARE = 256
#: Tasks over which the rows of one band or entry are spread where it is looked up.
DEAL = 16


@lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and overlapping rows of the second: row p has its values from place p on."""
    rng = np.random.default_rng(31)
    first = rng.permutation(CIRCLE)
    second = rng.permutation(CIRCLE).astype(np.uint32)
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: COORDINATES - 1]]), COORDINATES)


def signature(shingles: np.ndarray) -> np.ndarray:
    first, rows = permutations()
    places = np.sort(first[(shingles >> np.uint64(7)).astype(np.int64) & (CIRCLE - 1)])
    least = np.full(COORDINATES, np.uint32(0xFFFFFFFF))
    for at in range(0, len(places), 2048):
        np.minimum(least, rows[places[at : at + 2048]].min(0), out=least)
    return least


def band_keys(sig: np.ndarray) -> np.ndarray:
    x = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = words.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1))
    for r in range(ROWS):
        key = words.mix(key * words.BASE + x[:, r])
    return key.view(np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row, A-Z folded."""
    out = []
    for i, j in words.blocks(offsets):
        part, off = words.FOLD[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        is_word = ~words.SPACE[part]
        starts, ends, rows = words.spans(is_word, off)
        keys = words.hashes(part, is_word, starts, ends)
        n = np.maximum(len(keys) - size + 1, 0)
        whole = np.zeros(n, np.uint64)
        for k in range(size):
            whole = words.mix(whole * words.BASE + keys[k : k + n])
        edges = np.searchsorted(rows, np.arange(j - i + 1))
        for r in range(j - i):
            a, b = int(edges[r]), int(edges[r + 1])
            if b - a >= size:
                out.append(np.unique(whole[a : b - size + 1]))
            elif b > a:
                short = np.full(1, b - a, np.uint64)
                for k in range(a, b):
                    short = words.mix(short * words.BASE + keys[k])
                out.append(short)
            else:
                out.append(np.empty(0, np.uint64))
    return out


def _sketch(size: int):
    def run(batches):
        for batch in batches:
            sets = shingle_sets(*words.column_bytes(batch.column(1)), size)
            with np.errstate(over="ignore"):
                sums = [[int(words.mix(s + np.uint64(k)).sum().astype(np.int64)) for s in sets] for k in (1, 2)]
            bands = [band_keys(signature(s)).tolist() if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "d1", "d2", "bands"])

    return run


def _full(size: int):
    def run(batches):
        for batch in batches:
            sets = shingle_sets(*words.column_bytes(batch.column(1)), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([int(words.mix(s).sum().astype(np.int64)) for s in sets], pa.int64())], names=["node", "n", "shingles", "sid"])

    return run


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, c) of every node on an edge (a, b): c is the smallest node it is connected with.

    Each round takes the least label of the neighbours, then the label of the label.
    """
    both = scratch.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("c")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("n2"), F.col("c").alias("c2")), F.col("b") == F.col("n2")).groupBy("a").agg(F.min("c2").alias("c2"))
        near = scratch.cut(labels.join(seen, F.col("node") == F.col("a")).select("node", "c", F.least("c", "c2").alias("low")))
        # the label of each label in use; nodes of one label are spread, as it can be that of very many
        lows = near.select(F.col("low").alias("n3")).distinct().join(near.select("node", F.col("low").alias("low3")), F.col("n3") == F.col("node"))
        jump = lows.select("n3", "low3", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))).alias("copy"))
        dealt = near.withColumn("deal", F.pmod(F.xxhash64("node"), F.lit(DEAL)).cast("int"))
        new = scratch.cut(dealt.join(jump, (F.col("low") == F.col("n3")) & (F.col("deal") == F.col("copy")), "left").select("node", F.coalesce(F.least("low", "low3"), "low").alias("c"), (F.least("low", F.coalesce("low3", "low")) < F.col("c")).alias("moved")))
        done = new.where("moved").limit(1).count() == 0
        scratch.drop(labels, near)
        labels = new.select("node", "c")
        labels._siltloom_path = new._siltloom_path
        if done:
            return labels


def within(rows: DataFrame, few: DataFrame, key: str, of: str) -> DataFrame:
    """``rows`` whose ``key`` is among those of ``few``, a column ``of``; rows of one key are spread by their node."""
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("node"), F.lit(DEAL)).cast("int"))
    copies = few.select(of, F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))).alias("copy"))
    return dealt.join(copies, (F.col(key) == F.col(of)) & (F.col("deal") == F.col("copy")), "left_semi").drop("deal")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id and kept per row of ``docs``; links have 100 * common >= percent * union."""
    scratch = Scratch(docs.sparkSession, "minhash")
    with scratch.dropping(), scratch.batches(512):
        source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
        sketches = scratch.cut(source.mapInArrow(_sketch(size), "id bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>"))
        linked = sketches.where("n > 0 and id is not null")
        classes = scratch.cut(linked.groupBy("n", "d1", "d2").agg(F.min("id").alias("node")))
        reps = linked.join(classes.select(F.col("n").alias("n2"), F.col("d1").alias("e1"), F.col("d2").alias("e2"), "node"), (F.col("id") == F.col("node")) & (F.col("n") == F.col("n2")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")))
        bands = scratch.cut(reps.select("node", "n", F.explode("bands").alias("band")))
        groups = bands.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last"), F.count("*").alias("members")).where("hub < last").select(F.col("band").alias("g"), "hub", "members")
        members = scratch.cut(bands.join(groups, F.col("band") == F.col("g")).select("band", "node", "n", "hub", "members"))
        scratch.drop(bands)
        wanted = members.select(F.col("node").alias("w")).distinct()
        chosen = source.join(wanted, F.col("id") == F.col("w"), "left_semi")
        sets = scratch.cut(chosen.mapInArrow(_full(size), "node bigint, n bigint, shingles array<bigint>, sid bigint"))

        def with_sets(pairs: DataFrame, node: str) -> DataFrame:
            """``pairs`` beside n and shingles of one of their nodes; a node of many pairs has its rows spread."""
            shares = scratch.cut(pairs.groupBy(F.col(node).alias("of")).agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")))
            spread = sets.join(shares, F.col("node") == F.col("of")).select(F.col("node").alias(f"{node}2"), F.col("n").alias(f"n{node}"), F.col("shingles").alias(f"s{node}"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias(f"x{node}"))
            other = "b" if node == "a" else "a"
            dealt = pairs.join(shares, F.col(node) == F.col("of")).withColumn("x", F.pmod(F.xxhash64(other), F.col("shares")).cast("int")).drop("of", "shares")
            return dealt.join(spread, (F.col(node) == F.col(f"{node}2")) & (F.col("x") == F.col(f"x{node}"))).drop("x", f"x{node}", f"{node}2")

        def confirmed(pairs: DataFrame) -> DataFrame:
            """The pairs (a, b) whose sets are similar enough."""
            near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
            common = F.size(F.array_intersect("sa", "sb"))
            return with_sets(with_sets(pairs, "b"), "a").where(near).where(common * 100 >= (F.col("na") + F.col("nb") - common) * percent).select("a", "b")

        first = members.where("node <> hub")
        links = scratch.cut(confirmed(scratch.cut(first.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())))
        labels = components(links, scratch)

        def placed(df: DataFrame) -> DataFrame:
            """``df`` with the component c of its nodes."""
            of = labels.select(F.col("node").alias("l"), F.col("c").alias("lc"))
            return df.join(of, F.col("node") == F.col("l"), "left").withColumn("c", F.coalesce("lc", "node")).drop("l", "lc")

        # two members have met; a larger group may hold links between members other than its smallest id
        several = placed(members.where("members > 2").select("band", "node"))
        open_bands = several.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select(F.col("band").alias("ob"))
        left = within(several, open_bands, "band", "ob").select(F.col("node").alias("u")).distinct()
        shingles = scratch.cut(sets.join(left, F.col("node") == F.col("u"), "left_semi").select("node", "n", "sid", F.explode("shingles").alias("s")))
        counts = shingles.groupBy(F.col("s").alias("s2")).agg(F.count("*").alias("freq"))
        ranked = shingles.join(counts, F.col("s") == F.col("s2")).groupBy("node", "n", "sid").agg(F.array_sort(F.collect_list(F.struct("freq", "s"))).alias("t"))
        length = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
        index = ranked.select("node", "n", F.posexplode(F.slice("t", F.lit(1), length)).alias("pos", "t")).where("t.freq > 1").select("node", "n", F.col("t.s").alias("s"), (F.col("n") - F.col("pos")).alias("tail"), F.pmod(F.xxhash64("node", "t.s"), F.col("t.freq")).alias("rank"))
        active = scratch.cut(index)
        scratch.drop(shingles)
        lower, upper = 0, PIVOTS
        while True:
            near = placed(active.select("s", "node", "n", "tail", "rank"))
            entries = near.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select(F.col("s").alias("os"))
            # a member whose rank was below an earlier bound has met all others
            active = scratch.cut(within(near, entries, "s", "os").where(F.col("rank") >= lower))
            if active.limit(1).count() == 0:
                break
            # similar texts are of one length class or of neighbouring ones
            classed = active.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent))))
            p = classed.where(F.col("rank") < upper).withColumn("class", F.explode(F.array(*(F.col("class") + k for k in (-1, 0, 1))))).alias("p")
            m = classed.alias("m")
            met = F.expr(f"p.s = m.s and p.class = m.class and p.c <> m.c and (m.rank >= {upper} or p.node < m.node) and least(p.tail, m.tail) * {100 + percent} >= (p.n + m.n) * {percent}")
            pairs = scratch.cut(p.join(m, met).select(F.least("p.node", "m.node").alias("a"), F.greatest("p.node", "m.node").alias("b")).distinct())
            more = scratch.cut(confirmed(pairs))
            if more.limit(1).count():
                links = scratch.cut(links.unionByName(more))
                labels = components(links, scratch)
            lower, upper = upper, upper * GROWTH
        of_class = classes.select(F.col("n").alias("n2"), F.col("d1").alias("e1"), F.col("d2").alias("e2"), "node")
        found = placed(of_class).select("n2", "e1", "e2", "c")
        rows = sketches.select("id", "n", "d1", "d2").join(found, (F.col("id").isNotNull()) & (F.col("n") == F.col("n2")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
        component = F.coalesce("c", "id")
        return scratch.keep(rows.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")))


def brute_force(rows: list[tuple[int, str | None]], size: int, percent: int) -> list[tuple[int, int, int, bool]]:
    """The definition, for tests."""
    import re

    fold = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and sets[i]:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [(i, len(s), root(i), root(i) == i) for i, s in sets.items()]
