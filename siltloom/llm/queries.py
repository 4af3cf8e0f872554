"""The contract queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import bpe, chat_trees, langid, minhash, mixing, quality_bands, secrets, suffix_dedup, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Send the package to the workers, and bound what one Arrow batch holds: texts can be long."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return quality_bands.assess(table(spark, sf_dir, "documents"))


def op8_langid_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).drop("text")


def op10_toxicity_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_chat_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_trees.digests(chat_trees.format_trees(chat_trees.linear(talks)))


def op3_minhash_circulant(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85).withColumnRenamed("id", "doc_id")


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan_paths(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_suffix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op6_topk_norm_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_bpe_rank_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), vocabulary()))


QUERIES = {f.__name__: f for f in (op1_compression_bands, op2_chat_reply_trees, op3_minhash_circulant, op4_secret_ledger, op5_suffix_doubling, op6_topk_norm_sorted, op7_bpe_rank_array, op8_langid_byte_cnn, op9_temperature_mixing, op10_toxicity_counterfactual)}
ORACLE: dict[str, str] = {"op2_chat_reply_trees": chat_trees.ORACLE, "op4_secret_ledger": secrets.ORACLE, "op6_topk_norm_sorted": topk.ORACLE, "op9_temperature_mixing": mixing.ORACLE}
