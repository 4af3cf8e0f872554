"""Exact top-k inner products over norm-sorted blocks.

Components become floor(256 * x), taken as doubles. Candidates are range-sorted by descending length
and packed into blocks. Queries, also in blocks, meet the blocks of candidates in passes of descending
length (``PASSES`` blocks, then the rest). Each pass raises a query's bound, its k-th best score so far. A
block whose longest vector times the query's length is below the bound can't matter; within a block,
candidates are cut off at the length that Cauchy-Schwarz asks for, then by the partial product over
the leading SVD directions plus the product of the residual lengths. What survives is scored in integers.

Which blocks meet is settled on their numbers alone. Then vectors are sent to the pairs; a block in many
pairs is sent to as many tasks as its pairs need (``SHARE`` for each), so no block gathers them in one.

Scores are exact: products stay below 2**53 in doubles, else they are summed as Python integers, and
saturate at 64 bits. Vectors that are null, empty or hold a null or non-finite component take no part,
nor do null ids; vectors only meet others of their dimension. A query skips rows with its own id, so
of rows that repeat an id none is its own neighbour. Ties go to the smaller id; a candidate id that
is repeated counts once with each of its rows. Extra columns are ignored; an empty table gives an
empty result. Only the d x d second moments, summed by Spark, come to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

BLOCK_ROWS = 4096
QUERY_ROWS = 1024
#: Leading directions whose partial products are computed before the residual bound is applied.
LEAD_SHARE = 0.25
#: Blocks of each pass but the last, which takes the rest.
PASSES = (1, 8, 64)
#: Pairs of one block in one task, about.
SHARE = 32
BATCH = "id bigint, dim int, norm double, vec binary"


def _integers(batches):
    """id, dim, norm and packed floor(256 * x) of valid vectors."""
    for batch in batches:
        ids, dims, norms, packed = [], [], [], []
        lists = batch.column(1).cast(pa.list_(pa.float64()))
        for i, x in zip(batch.column(0).to_pylist(), lists):
            if i is None or not x.is_valid or len(x) == 0 or x.values.null_count:
                continue
            v = np.floor(256.0 * x.values.to_numpy(zero_copy_only=False))
            if not np.isfinite(v).all():
                continue
            ids.append(i)
            dims.append(len(v))
            norms.append(float(np.sqrt(np.minimum(v @ v, 1e308))))
            packed.append(v.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(norms, pa.float64()), pa.array(packed, pa.binary())], names=["id", "dim", "norm", "vec"])


def _moments(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = batch.column(0).to_numpy()
        for d in np.unique(dims):
            x = np.array([np.frombuffer(v, np.float64) for v, k in zip(batch.column(1).to_pylist(), dims) if k == d])
            sums[int(d)] = sums.get(int(d), 0) + x.T @ x
    for d, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * m.size, pa.int32()), pa.array(np.arange(m.size)), pa.array(m.ravel())], names=["dim", "at", "v"])


def _blocks(rows: int):
    """Packs the rows of a task, sorted by dim and descending norm, into blocks of one dim each."""

    def run(batches):
        from pyspark import TaskContext

        task, n, held = TaskContext.get().partitionId(), 0, []

        def flush(part):
            nonlocal n
            n += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([task * (1 << 32) + n]), pa.array([part[0][1]], pa.int32()), pa.array([max(r[2] for r in part)]), pa.array([np.array([r[0] for r in part], np.int64).tobytes()]), pa.array([np.array([r[2] for r in part]).tobytes()]), pa.array([b"".join(r[3] for r in part)])],
                names=["block", "dim", "top_norm", "ids", "norms", "vecs"],
            )

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns[:4])):
                if held and (len(held) == rows or held[0][1] != row[1]):
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return run


BLOCK = "block bigint, dim int, top_norm double, ids binary, norms binary, vecs binary"


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of q with the rows of c."""
    reach = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1]
    if reach < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in c] for x in q]
    return np.array([[min(max(s, -(2**63)), 2**63 - 1) for s in r] for r in exact], np.int64).reshape(len(q), len(c))


def best_of(q_ids, q, q_norms, bound, c_ids, c, c_norms, rotation, lead, k):
    """(query index, candidate ids, scores): each query's k best of one block that reach its bound.

    Candidates come in descending norm; ``bound`` is -inf where a query has no bound yet.
    """
    out = []
    qr, cr = q @ rotation, c @ rotation
    q_rest, c_rest = np.sqrt((qr[:, lead:] ** 2).sum(1)), np.sqrt((cr[:, lead:] ** 2).sum(1))
    for i in range(len(q)):
        least = bound[i] - 1e-6 * (1 + abs(bound[i])) if np.isfinite(bound[i]) else -np.inf
        slack = 1e-9 * q_norms[i]
        n = len(c) if least <= 0 else int(np.searchsorted(-(c_norms * (q_norms[i] * (1 + 1e-9))), -least, "right"))
        if not n:
            continue
        upper = cr[:n, :lead] @ qr[i, :lead] + c_rest[:n] * q_rest[i] + slack * c_norms[:n]
        near = np.flatnonzero(upper >= least)
        near = near[c_ids[near] != q_ids[i]]
        if not len(near):
            continue
        s = exact_scores(q[i : i + 1], c[near])[0]
        order = np.lexsort((c_ids[near], -s))[:k]
        out.append((i, c_ids[near][order], s[order]))
    return out


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vec: str = "embedding", k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each query."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    with scratch.dropping(), scratch.batches(512):
        asked = vectors.where(is_query & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), vec)
        items = scratch.cut(vectors.select(F.col(key).cast("bigint").alias("id"), vec).mapInArrow(_integers, BATCH))
        wanted = asked.mapInArrow(_integers, BATCH)
        sums = items.select("dim", "vec").mapInArrow(_moments, "dim int, at bigint, v double").groupBy("dim", "at").agg(F.sum("v").alias("v")).collect()
        rotations = {}
        for d in {r["dim"] for r in sums}:
            gram = np.zeros(d * d)
            for r in sums:
                if r["dim"] == d:
                    gram[r["at"]] = r["v"]
            _, vectors_of = np.linalg.eigh(np.nan_to_num(gram.reshape(d, d), posinf=1e300, neginf=-1e300))
            rotations[d] = vectors_of[:, ::-1].copy()
        n = items.count()
        parts = max(1, math.ceil(n / BLOCK_ROWS))
        blocks = scratch.cut(items.repartitionByRange(parts, "dim", F.desc("norm"), "id").sortWithinPartitions("dim", F.desc("norm"), "id").mapInArrow(_blocks(BLOCK_ROWS), BLOCK))
        n_asked = scratch.cut(wanted)
        q_parts = max(1, math.ceil(n_asked.count() / QUERY_ROWS))
        q_blocks = scratch.cut(n_asked.repartition(q_parts).sortWithinPartitions("dim", F.desc("norm"), "id").mapInArrow(_blocks(QUERY_ROWS), BLOCK).select(*(F.col(c).alias(f"q_{c}") for c in ("block", "dim", "top_norm", "ids", "norms", "vecs"))))
        n_queries = q_blocks.count()
        turned = spark.sparkContext.broadcast(rotations)

        def kernel(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    d = row["dim"]
                    load = lambda name, kind=np.float64: np.frombuffer(row[name], kind)  # noqa: B023, E731
                    q_ids, q_norms, c_ids = load("q_ids", np.int64), load("q_norms"), load("ids", np.int64)
                    bound = np.full(len(q_ids), -np.inf)
                    for x in row["bounds"] or ():
                        bound[x["at"]] = x["bound"]
                    found = best_of(q_ids, load("q_vecs").reshape(-1, d), q_norms, bound, c_ids, load("vecs").reshape(-1, d), load("norms"), turned.value[d], max(1, int(d * LEAD_SHARE)), k)
                    at = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)
                    joined = lambda i: np.concatenate([np.empty(0, np.int64), *(f[i] for f in found)])  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["q_block"])), pa.array(at), pa.array(q_norms[at]), pa.array(q_ids[at]), pa.array(joined(1)), pa.array(joined(2))], names=["q_block", "at", "q_norm", "query_id", "vec_id", "score"])

        shape = "q_block bigint, at bigint, q_norm double, query_id bigint, vec_id bigint, score bigint"
        names = blocks.select("block", F.col("dim").alias("b_dim"), "top_norm").withColumn("place", F.row_number().over(Window.partitionBy("b_dim").orderBy(F.desc("top_norm"), "block")))
        names = scratch.cut(names)
        n_places = names.agg(F.max("place")).first()[0] or 0
        spread_q, spread_b = max(1, math.ceil(n_places / SHARE)), max(1, math.ceil(n_queries / SHARE))
        copies = lambda df, n, name: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        top = Window.partitionBy("q_block", "at").orderBy(F.desc("score"), "vec_id")
        best, bounds, start = None, None, 1
        for size in (*PASSES, n_places):
            if start > n_places:
                break
            every = q_blocks.select("q_block", "q_dim", (F.octet_length("q_ids") / 8).alias("rows"))
            if bounds is None:
                every = every.withColumns({"least_norm": F.lit(float("-inf")), "bounds": F.lit(None).cast("array<struct<at: bigint, bound: double>>")})
            else:
                every = every.join(bounds, F.col("q_block") == F.col("q2"), "left").withColumn("least_norm", F.when(F.col("n") == F.col("rows"), F.col("least")).otherwise(F.lit(float("-inf"))))
            near = names.where(f"place >= {start} and place < {start + size}").repartition(max(1, n_places // 8), "block")
            pairs = near.join(every, (F.col("b_dim") == F.col("q_dim")) & (F.col("top_norm") * (1 + 1e-9) >= F.col("least_norm"))).select("block", "q_block", "bounds")
            pairs = scratch.cut(pairs.withColumns({"to_q": F.pmod(F.xxhash64("block"), F.lit(spread_q)).cast("int"), "to_b": F.pmod(F.xxhash64("q_block"), F.lit(spread_b)).cast("int")}))
            sent = pairs.join(copies(q_blocks.withColumnRenamed("q_block", "q3"), spread_q, "x"), (F.col("q_block") == F.col("q3")) & (F.col("to_q") == F.col("x")))
            met = sent.join(copies(blocks.withColumnRenamed("block", "b3"), spread_b, "y"), (F.col("block") == F.col("b3")) & (F.col("to_b") == F.col("y")))
            found = met.select("q_block", "q_ids", "q_norms", "q_vecs", "bounds", "ids", "norms", "vecs", "dim").mapInArrow(kernel, shape)
            found = found if best is None else best.unionByName(found)
            best = scratch.cut(found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).drop("r"))
            full = best.groupBy("q_block", "at", "q_norm").agg(F.count("*").alias("m"), F.min("score").cast("double").alias("bound")).where(F.col("m") >= k)
            bounds = full.groupBy(F.col("q_block").alias("q2")).agg(F.count("*").alias("n"), F.min(F.col("bound") / F.greatest("q_norm", F.lit(1e-300))).alias("least"), F.collect_list(F.struct("at", "bound")).alias("bounds"))
            start += size
        if best is None:
            best = spark.createDataFrame([], shape)
        rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return scratch.keep(best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def brute_force(rows: list[tuple[int, list[float] | None]], is_query, k: int = 5) -> list[tuple[int, int, int, int]]:
    """The definition, for tests."""
    ok = [(i, [math.floor(256 * float(v)) for v in x]) for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for i, x in ok:
        if is_query(i):
            s = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in ok if j != i and len(y) == len(x))[:k]
            out += [(i, n + 1, j, -v) for n, (v, j) in enumerate(s)]
    return out


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
