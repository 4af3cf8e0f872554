"""Exact vector search."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructType

METRICS = ("cosine", "l2", "inner")
#: Questions of a block, and bytes of a block of vectors.
QUESTION_BLOCK, BLOCK_BYTES = 1024, 1 << 24
#: Questions scored at once.
AT_ONCE = 64


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Similarity of two array columns in doubles: higher is nearer (for l2 the negative distance)."""
    a, b = F.transform(a, lambda x: x.cast("double")), F.transform(b, lambda x: x.cast("double"))
    fold = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    if metric == "inner":
        return fold(F.zip_with(a, b, lambda x, y: x * y))
    if metric == "l2":
        return -F.sqrt(fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    dot = fold(F.zip_with(a, b, lambda x, y: x * y))
    return dot / F.sqrt(fold(F.transform(a, lambda x: x * x)) * fold(F.transform(b, lambda x: x * x)))


def nearest(vectors: DataFrame, question: list[float], k: int = 25, metric: str = "cosine", key: str = "chunk_id", vec: str = "embedding") -> DataFrame:
    """key and score of the k nearest vectors to one, by expressions and a distributed top-k."""
    q = F.array(*(F.lit(float(x)) for x in question))
    return vectors.select(key, similarity(F.col(vec), q, metric).alias("score")).orderBy(F.desc("score"), key).limit(k)


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    dot = q @ x.T
    if metric == "inner":
        return dot
    qq, xx = (q * q).sum(1)[:, None], (x * x).sum(1)[None]
    if metric == "l2":
        return 0.0 - np.sqrt(np.maximum(qq + xx - 2 * dot, 0))
    with np.errstate(invalid="ignore", divide="ignore"):
        return dot / np.sqrt(qq * xx)


def _packed(kind, rows: int, name: str):
    """Packs (key, vector) rows of a task into rows of keys and one binary, by dimension; invalid vectors are left out."""

    def run(batches):
        held: dict[int, list] = {}

        def flush(d):
            keys, parts = zip(*held.pop(d))
            return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([list(keys)], pa.list_(kind)), pa.array([b"".join(parts)], pa.binary())], names=[f"{name}_dim", f"{name}_keys", f"{name}_vecs"])

        for batch in batches:
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if v.is_valid and len(v) and v.values.null_count == 0:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    held.setdefault(len(x), []).append((key, x.tobytes()))
                    if len(held[len(x)]) == rows:
                        yield flush(len(x))
        for d in list(held):
            yield flush(d)

    return run


def _kernel(k: int, metric: str, query: str, key: str, kinds):
    """Of each question of a block its k best vectors of a block."""

    def run(batches):
        for batch in batches:
            for row in (one for i in range(batch.num_rows) for one in batch.slice(i, 1).to_pylist()):
                d = row["q_dim"]
                q, x = (np.frombuffer(row[c], np.float64).reshape(-1, d) for c in ("q_vecs", "x_vecs"))
                names = np.array(row["x_keys"])
                place = np.argsort(names, kind="stable").argsort(kind="stable")
                asked, found, scores = [], [], []
                # some questions at a time: a block of them against one of vectors is a large table
                scored = (s for at in range(0, len(q), AT_ONCE) for s in _scores(q[at : at + AT_ONCE], x, metric))
                for i, s in enumerate(scored):
                    near = np.flatnonzero(~np.isnan(s))
                    best = near[np.lexsort((place[near], -s[near]))[:k]]
                    asked += [row["q_keys"][i]] * len(best)
                    found += [row["x_keys"][j] for j in best]
                    scores.append(s[best])
                yield pa.RecordBatch.from_arrays([pa.array(asked, kinds[0]), pa.array(found, kinds[1]), pa.array(np.concatenate([np.empty(0), *scores]))], names=[query, key, "score"])

    return run


def search(vectors: DataFrame, questions: DataFrame, k: int = 25, metric: str = "cosine", key: str = "chunk_id", vec: str = "embedding", query: str = "query_id", q_vec: str = "q_embedding") -> DataFrame:
    """query, key, score and rank of each question's k nearest vectors, ties to the smaller key.

    Vectors are dealt into blocks of ``BLOCK_BYTES``, questions packed where they are. Each block of questions is
    sent to every group of vector blocks; none passes the driver. A pair of blocks gives k rows per question
    at most. Vectors that are null, of another dimension or without length take no part.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    spark = vectors.sparkSession
    kinds = (questions.schema[query].dataType, vectors.schema[key].dataType)
    arrow = tuple(to_arrow_type(x) for x in kinds)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, dim = vectors.agg(F.count("*"), F.max(F.size(vec))).first()
    rows = max(1, BLOCK_BYTES // (8 * max(dim or 1, 1)))
    blocks = max(1, math.ceil(n / rows))
    groups = min(blocks, 4 * parts)
    shape = lambda name, x: StructType().add(f"{name}_dim", IntegerType()).add(f"{name}_keys", ArrayType(x)).add(f"{name}_vecs", BinaryType())
    # few rows of questions in many small tasks would make many small blocks
    asked = questions.select(query, q_vec).where(F.col(q_vec).isNotNull()).coalesce(max(1, parts // 4)).mapInArrow(_packed(arrow[0], QUESTION_BLOCK, "q"), shape("q", kinds[0]))
    asked = asked.withColumn("q_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    items = vectors.select(key, vec).repartition(blocks).mapInArrow(_packed(arrow[1], rows, "x"), shape("x", kinds[1])).withColumn("x_group", F.spark_partition_id() % groups)
    pairs = asked.join(items, (F.col("q_group") == F.col("x_group")) & (F.col("q_dim") == F.col("x_dim"))).select("q_dim", "q_keys", "q_vecs", "x_keys", "x_vecs")
    found = pairs.mapInArrow(_kernel(k, metric, query, key, arrow), StructType().add(query, kinds[0]).add(key, kinds[1]).add("score", DoubleType()))
    best = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
