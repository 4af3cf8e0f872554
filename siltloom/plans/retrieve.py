"""Questions to ranked chunks, context and answers, many at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import strip
from ..operators import bm25, context, fusion, vector
from ..session import ship
from ..sources import adapters

BESIDE = ("doc_id", "kind", "title", "category", "source", "referenced_by")


def retrieve(questions: DataFrame, chunks: DataFrame, config: Config | None = None, index: bm25.Index | None = None, score=adapters.overlap_score) -> DataFrame:
    """query_id, question, rank, text and the BESIDE columns of the chunks for each question.

    ``questions``: query_id, question, q_embedding. ``chunks``: chunk_id, text, embedding and BESIDE.
    ``index``: a keyword index to reuse. ``score``: reranker over (question, text) columns.
    """
    ship(questions.sparkSession)
    config = config or Config()
    r = config.retrieval
    index = index or bm25.build(chunks)
    facts = chunks.select("chunk_id", "text", *BESIDE)
    near = vector.search(chunks, questions, r.vector_top_k, r.distance).where(F.col("score") >= r.score_threshold).join(facts, "chunk_id")
    words = bm25.top_k(index, questions, r.bm25_top_k).join(facts, "chunk_id")
    hits = fusion.fuse(near, words, r.vector_weight, r.bm25_weight, r.final_top_k)
    flat = hits.select("query_id", "rank", "score", "text", *(F.col(f"doc.{c}").alias(c) for c in BESIDE)).join(questions.select("query_id", "question"), "query_id")
    if not config.reranker.enabled:
        return flat
    return fusion.rerank(flat, score(F.col("question"), F.col("text")), min(config.reranker.candidate_count, r.final_top_k), config.reranker.top_k)


def answer(questions: DataFrame, chunks: DataFrame, config: Config | None = None, generate=adapters.extractive_answer, **more) -> DataFrame:
    """query_id, question, context, answer and sources of every valid question."""
    asked = questions.where(context.valid_question(F.col("question"))).withColumn("question", strip(F.col("question")))
    hits = retrieve(asked, chunks, config, **more)
    told = asked.select("query_id", "question").join(context.format_context(hits), "query_id", "left").join(context.source_items(hits), "query_id", "left")
    return told.select("query_id", "question", F.coalesce("context", F.lit("")).alias("context"), generate(F.coalesce("context", F.lit(""))).alias("answer"), "sources")
