"""Okapi BM25 over an inverted index, stored in blocks of chunks.

All postings of a chunk are in one block, so a chunk's scores are summed where its block is read, and only
the k best chunks of each block leave it. In a block the postings of a term are one row, in order of term.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StringType, StructType

from ..functions.text import SPACE
from ..session import cut, qualified, scratch, ship

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Words of questions that are sought in the files; of more, all files are read.
FEW = 200
#: Stored bytes of a collection, as Spark estimates them, in a bucket. spark.sql.shuffle.partitions bounds the buckets.
BUCKET_BYTES = 1 << 22
#: Bytes of text in a block, which a worker indexes and scores at once. A bucket has as many blocks as it needs.
BLOCK_BYTES = 1 << 23
#: Rows of an Arrow batch of postings.
ROWS = 1 << 14
#: Bytes of questions' terms that are sent to every block; more are joined by term.
SENT_BYTES = 1 << 25


def terms(text: Column) -> Column:
    """Words between white space, as they are written."""
    return F.filter(F.split(text, f"{SPACE}+", -1), lambda w: w != "")


@dataclass
class Index:
    """Stored tables: postings (block, term, n, docs, tfs, keys, dls), vocabulary (term, idf), documents (key, dl), the mean dl and the least idf."""

    postings: DataFrame
    vocabulary: DataFrame
    documents: DataFrame
    mean_length: float
    least_idf: float
    key: str


def _packed(x: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Lists of numbers as bytes, of as few each as the largest needs."""
    x = x.astype(np.min_scalar_type(x.max(initial=0)))
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * x.itemsize).astype(np.int32)), pa.py_buffer(x)])


def _unpacked(lists: pa.Array, n: np.ndarray) -> np.ndarray:
    """The numbers of packed lists of one block, one after another; ``n``: how many each has."""
    data = b"".join(lists.to_pylist())
    return np.frombuffer(data, f"u{len(data) // max(1, n.sum())}") if data else np.zeros(0, np.uint8)


def _opened(block):
    """Of a block its keys, lengths and terms, where each term's postings start, and their places and frequencies."""
    block = block.combine_chunks()
    term, n = block.column("term").to_pylist(), block.column("n").to_numpy()
    head = term.index(None)
    rest = np.delete(np.arange(len(term)), head)
    docs, tfs = (_unpacked(block.column(c).combine_chunks().take(pa.array(rest)), n[rest]) for c in ("docs", "tfs"))
    keys, dls = (block.column(c)[head].values for c in ("keys", "dls"))
    return keys, dls.to_numpy(), [term[i] for i in rest], np.concatenate([[0], np.cumsum(n[rest])]), docs.astype(np.int64), tfs.astype(np.float64)


def _inverted(kind: pa.DataType, size: int):
    """Turns (key, text) rows of a task, in order of key, into the postings of blocks of ``size`` bytes. A block is named by its first key."""
    names = ["block", "term", "n", "docs", "tfs", "keys", "dls"]

    def flush(keys: list, lengths: list, words: list):
        dl = np.array(lengths, np.int32)
        encoded = pa.concat_arrays(words).dictionary_encode()
        order = pc.array_sort_indices(encoded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        # a word's term and chunk in one number: equal ones are the occurrences in a chunk
        met, tf = np.unique(place[encoded.indices.to_numpy()] * len(dl) + np.repeat(np.arange(len(dl)), dl), return_counts=True)
        term, doc = np.divmod(met, len(dl))
        starts = np.concatenate([[0], np.searchsorted(term, np.arange(len(order) + 1))])
        n = np.diff(starts)
        n[0] = len(dl)
        alone = lambda x, t: pa.concat_arrays([pa.array([x], pa.list_(t)), pa.nulls(len(order), pa.list_(t))])
        columns = [
            pa.array([keys[0]] * len(n), kind),
            pa.concat_arrays([pa.array([None], pa.string()), encoded.dictionary.take(pa.array(order))]),
            pa.array(n.astype(np.int32)),
            _packed(doc, starts),
            _packed(tf, starts),
            # the first row, of no term, has the chunks and their lengths
            alone(keys, kind),
            alone(lengths, pa.int32()),
        ]
        out = pa.RecordBatch.from_arrays(columns, names=names)
        for at in range(0, out.num_rows, ROWS):
            yield out.slice(at, ROWS)

    def run(batches):
        keys, lengths, words, held = [], [], [], 0
        for batch in batches:
            flat = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                # chunks of equal key stay together, as their scores are one
                if held >= size and key != keys[-1]:
                    yield from flush(keys, lengths, [*words, pa.array(flat, pa.string())])
                    keys, lengths, words, held, flat = [], [], [], 0, []
                found = (text or b"").decode("utf-8", "replace").split()  # at white space as SPACE has it
                flat += found
                keys.append(key)
                lengths.append(len(found))
                held += len(text or b"")
            words.append(pa.array(flat, pa.string()))
        if keys:
            yield from flush(keys, lengths, words)

    return run


def build(chunks: DataFrame, key: str = "chunk_id", text: str = "text", epsilon: float = EPSILON, path: str | None = None) -> Index:
    """The index of a collection, stored in ``path`` (else in the shared folder) and read from there by every question.

    The collection is read once. Negative inverse frequencies become ``epsilon`` times the mean over all terms.
    Every block has one row more, of null term, which tells its chunks' lengths.
    """
    spark = chunks.sparkSession
    ship(spark)
    root = qualified(spark, path or scratch(spark, "bm25"))
    size = int(str(chunks.select(key, text)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = min(int(spark.conf.get(f"spark.sql.{x}")) for x in ("shuffle.partitions", "sources.bucketing.maxBuckets"))
    buckets = min(most, max(spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES)))
    kind = chunks.schema[key].dataType
    shape = StructType().add("block", kind).add("term", StringType()).add("n", IntegerType()).add("docs", BinaryType()).add("tfs", BinaryType()).add("keys", ArrayType(kind)).add("dls", ArrayType(IntegerType()))
    # all keys of a task are of one bucket, and so is a block's name
    rows = chunks.select(key, F.col(text).alias("__text")).repartition(buckets, key).sortWithinPartitions(key).mapInArrow(_inverted(to_arrow_type(kind), BLOCK_BYTES), shape)
    name = f"siltloom_bm25_{uuid.uuid4().hex}"
    try:
        rows.write.bucketBy(buckets, "block").option("compression", "zstd").option("path", f"{root}/postings").saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    postings = _bucketed(spark, f"{root}/postings", buckets)
    n, mean_length = _documents(postings, key).agg(F.count("*"), F.avg("dl")).first()
    df = postings.where("term is not null").groupBy("term").agg(F.sum("n").cast("double").alias("df"))
    raw = cut(df.select("term", (F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf")), f"{root}/vocabulary")
    mean, least = raw.agg(F.avg("idf"), F.min("idf")).first()
    rare = (mean or 0.0) * epsilon
    least_idf = min(rare, 0.0) if (least or 0.0) < 0 else 0.0
    spark.createDataFrame([(float(n), float(mean_length or 0), float(least_idf), float(rare), buckets)], "n double, mean_length double, least_idf double, rare double, buckets int").coalesce(1).write.parquet(f"{root}/size")
    return load(spark, root, key)


def _documents(postings: DataFrame, key: str) -> DataFrame:
    return postings.where("term is null").select(F.explode(F.arrays_zip("keys", "dls")).alias("d")).select(F.col("d.keys").alias(key), F.col("d.dls").cast("double").alias("dl"))


def _bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """Postings, with Spark knowing their buckets. Only a table's definition tells it, so there is one meanwhile; the files stay."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    name = f"siltloom_bm25_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (block) INTO {buckets} BUCKETS LOCATION '{path}'")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def load(spark: SparkSession, path: str, key: str = "chunk_id") -> Index:
    """A stored index."""
    root = qualified(spark, path)
    size = spark.read.parquet(f"{root}/size").first()
    postings = _bucketed(spark, f"{root}/postings", size["buckets"])
    idf = F.when(F.col("idf") < 0, F.lit(size["rare"])).otherwise(F.col("idf"))
    vocabulary = spark.read.parquet(f"{root}/vocabulary").select("term", idf.alias("idf"))
    return Index(postings, vocabulary, _documents(postings, key), size["mean_length"], size["least_idf"], key)


def _met(s: np.ndarray, hit: np.ndarray, place: np.ndarray, k: int | None) -> np.ndarray:
    """Chunks with a hit; of more than k, those that can be among the k best, with ties to nine places by ``place``."""
    at = np.flatnonzero(hit)
    if k is None or len(at) <= k:
        return at
    # Spark rounds decimal digits, this the binary number: they differ by a last place at most
    least = np.partition(s[at], len(at) - k)[len(at) - k] - 3e-9
    at = at[s[at] >= least]
    at = at[np.lexsort((place[at], -s[at]))]
    # equal scores round alike, so the k smallest keys of each will do
    new = np.flatnonzero(np.diff(s[at], prepend=np.inf))
    return at[np.arange(len(at)) - np.repeat(new, np.diff(new, append=len(at))) < k]


def _scorer(asked: dict, idf: dict, mean_length: float, k: int | None, k1: float, b: float, kinds, names):
    """Scores of a block's chunks: query, key, score of every hit, or of those that can be among a question's k best."""

    def run(block):
        keys, dl, terms_of, ends, place_of, tf = _opened(block)
        encoded = keys.dictionary_encode(null_encoding="encode")
        doc, size = encoded.indices.to_numpy()[place_of], len(encoded.dictionary)
        place = np.empty(size, np.int64)
        place[pc.array_sort_indices(encoded.dictionary).to_numpy()] = np.arange(size)
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[place_of] / mean_length))
        rows = {t: slice(ends[i], ends[i + 1]) for i, t in enumerate(terms_of)}
        who, found, scores = [], [], []
        for query, words in asked.items():
            s, hit = np.zeros(size), np.zeros(size, bool)
            for t, times in words:
                if (r := rows.get(t)) is not None:
                    np.add.at(s, doc[r], times * idf[t] * part[r])
                    hit[doc[r]] = True
            at = _met(s, hit, place, k)
            if len(at):
                who.append((query, len(at)))
                found.append(at)
                scores.append(s[at])
        queries = pa.array([q for q, _ in who], kinds[0]).take(pa.array(np.repeat(np.arange(len(who)), [n for _, n in who]), pa.int64()))
        chunks = encoded.dictionary.take(pa.array(np.concatenate([np.empty(0, np.int64), *found]), pa.int64()))
        return pa.Table.from_arrays([queries, chunks.cast(kinds[1]), pa.array(np.concatenate([np.empty(0), *scores]))], names=names)

    return run


def _asked(index: Index, questions: DataFrame, query: str, text: str) -> tuple[DataFrame, Column, bool]:
    """The terms asked for (query, term, times, idf), the rows of postings to look at, and whether the terms can be sent."""
    words = questions.select(query, F.explode(terms(F.col(text))).alias("term"))
    asked = words.groupBy(query, "term").agg(F.count("*").cast("double").alias("times"))
    first = [r[0] for r in words.select("term").limit(FEW + 1).collect()]
    if len(first) <= FEW:
        sought = F.col("term").isin(sorted(set(first)))
        known = index.vocabulary.where(sought).join(F.broadcast(asked), "term")
        return known, F.col("term").isNull() | sought, sum(len(w.encode()) + 64 for w in first) <= SENT_BYTES
    fits = words.agg(F.sum(F.octet_length("term") + 64)).first()[0] <= SENT_BYTES
    return index.vocabulary.join(F.broadcast(asked) if fits else asked, "term"), F.lit(True), fits


def _rows(names: list[str], kind: pa.DataType):
    """A block's postings one by one: key, dl, term, tf."""

    def run(block):
        keys, dl, term, ends, doc, tf = _opened(block)
        which = pa.array(np.repeat(np.arange(len(term)), np.diff(ends)), pa.int64())
        return pa.Table.from_arrays([keys.take(pa.array(doc)).cast(kind), pa.array(dl[doc].astype(np.float64)), pa.array(term, pa.string()).take(which), pa.array(tf)], names=names)

    return run


def _parts(index: Index, known: DataFrame, wanted: Column, query: str, fits: bool, k1: float, b: float) -> DataFrame:
    """What each term of a question adds to the score of each chunk that has it."""
    ship(known.sparkSession)
    kind = index.postings.schema["block"].dataType
    shape = StructType().add(index.key, kind).add("dl", DoubleType()).add("term", StringType()).add("tf", DoubleType())
    rows = index.postings.where(wanted).groupBy("block").applyInArrow(_rows(shape.names, to_arrow_type(kind)), shape)
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(index.mean_length))
    return rows.join(F.broadcast(known) if fits else known, "term").select(query, index.key, (F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / norm).alias("part"))


def _sent(index: Index, known: DataFrame, wanted: Column, questions: DataFrame, query: str, k: int | None, k1: float, b: float) -> DataFrame:
    """query, key and score by blocks, each of which gets all terms asked for."""
    spark = known.sparkSession
    ship(spark)
    asked, idf = {}, {}
    for r in sorted(known.select(query, "term", "times", "idf").collect(), key=lambda r: r[1]):
        asked.setdefault(r[0], []).append((r[1], r[2]))
        idf[r[1]] = r[3]
    # beside the rows of no term
    sought = spark.createDataFrame(pa.table({"term": pa.array([None, *idf], pa.string())}))
    types = (questions.schema[query].dataType, index.postings.schema["block"].dataType)
    run = _scorer(asked, idf, index.mean_length, k, k1, b, tuple(to_arrow_type(t) for t in types), [query, index.key, "score"])
    postings = index.postings.where(wanted)
    met = postings.join(F.broadcast(sought), postings["term"].eqNullSafe(sought["term"]), "left_semi")
    return met.groupBy("block").applyInArrow(run, StructType().add(query, types[0]).add(index.key, types[1]).add("score", DoubleType()))


def scores(index: Index, questions: DataFrame, query: str = "query_id", text: str = "question", k1: float = K1, b: float = B) -> DataFrame:
    """Score of every chunk that shares a term with a question; repeated terms of a question count each time.

    Few words are sought in the files, which are in order of term; of more, every block meets all terms asked for.
    """
    known, wanted, fits = _asked(index, questions, query, text)
    if fits:
        return _sent(index, known, wanted, questions, query, None, k1, b)
    return _parts(index, known, wanted, query, fits, k1, b).groupBy(query, index.key).agg(F.sum("part").alias("score"))


def top_k(index: Index, questions: DataFrame, k: int = 15, query: str = "query_id", text: str = "question", k1: float = K1, b: float = B) -> DataFrame:
    """query, key, score and rank of each question's k best chunks, ties (to nine places) to the smaller key.

    Always k rows if the collection has as many: chunks without a hit score 0, those of smallest key first.
    """
    fill = index.documents.select(index.key).orderBy(index.key).limit(k)
    zeros = questions.select(query).distinct().join(F.broadcast(fill)).select(query, index.key, F.lit(0.0).alias("part"))
    best = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), index.key)
    ranked = lambda parts: parts.groupBy(query, index.key).agg(F.sum("part").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    known, wanted, fits = _asked(index, questions, query, text)
    # where no score is negative, what the fill adds can't change which hits are best
    if index.least_idf < 0:
        found = _parts(index, known, wanted, query, fits, k1, b)
    elif fits:
        found = _sent(index, known, wanted, questions, query, k, k1, b).withColumnRenamed("score", "part")
    else:
        found = ranked(_parts(index, known, wanted, query, fits, k1, b)).select(query, index.key, F.col("score").alias("part"))
    return ranked(found.unionByName(zeros))
