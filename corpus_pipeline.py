"""A training corpus from raw documents: toxicity, near duplicates, secrets, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Rows that a stage has no reason to touch pass it unchanged: null and empty texts aren't
toxic, duplicate nothing and hold no secret. An empty table gives an empty result in every stage. Texts of
any length are taken whole. Extra columns, whatever their names, pass every stage but the last, which
drops them: a stage gives its operator only the columns that it reads, under names of its own, and
returns the columns it was given.

1. ``toxicity`` fits the classifier on the labels outside its held-out fold and drops texts that it
   scores 0.5 or more.
2. ``near_dedup`` keeps of each class of near duplicates (five-word shingles, similarity 0.8) the
   document of smallest id, so ties can't arise. Rows that repeat an id are one document and stay or go
   together; rows of null id stay.
3. ``secret_scan`` replaces every secret found by ``[secret]`` and sets n_chars anew where it did.
4. ``mixing`` reads every source whole and small ones up to twice, as often as the temperature says; the
   copies of a document are rows.
5. ``bpe`` returns doc_id, lang, source, n_tokens, ids (little-endian uint32) and the SHA-256 of ids and
   of the text decoded from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltloom.llm import bpe, minhash, mixing, secrets, toxicity
from siltloom.llm.queries import table, tune, vocabulary
from siltloom.llm.scratch import Scratch


def hidden(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with private column names, and the private name of each column."""
    names = {c: f"__own{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def shown(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that were hidden, under their own names."""
    return df.select(*(F.col(private).alias(c) for c, private in names.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    own, names = hidden(docs)
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return shown(toxicity.score(own, model, text=names["text"]).where("score < 0.5"), names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    gone = minhash.near_duplicates(docs).where("not kept").select(F.col("id").alias("__gone")).distinct()
    own, names = hidden(docs)
    return shown(own.join(gone, F.col(names["doc_id"]) == F.col("__gone"), "left_anti"), names)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, names = hidden(docs)
    text, n_chars = names["text"], names["n_chars"]
    marked = secrets.scan_paths(own, text).withColumn("__hit", F.size("spans") > 0)
    clean = secrets.redact(marked, text)
    return shown(clean.withColumn(n_chars, F.when(F.col("__hit"), F.length(text).cast("bigint")).otherwise(F.col(n_chars))), names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, names = hidden(docs)
    return shown(mixing.mix(own, names["doc_id"], names["source"], names["text"]), names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    keep = ("doc_id", "lang", "source")
    encoded = bpe.encode(docs, vocabulary(), keep=keep)
    return encoded.select(*keep, "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mix_sources), ("bpe", encode)]
#: The classifier's weights can't be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
