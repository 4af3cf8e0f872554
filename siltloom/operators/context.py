"""Numbered context and source lists from ranked hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\n\n---\n\n"


def block(rank: Column, title: Column, category: Column, source: Column, text: Column) -> Column:
    """'[i] title (category) - source', then the text; missing parts are left out."""
    shown = lambda c: F.coalesce(c, F.lit(""))
    head = F.concat(
        F.lit("["), rank.cast("string"), F.lit("] "), shown(title),
        F.when(shown(category) != "", F.concat(F.lit(" ("), category, F.lit(")"))).otherwise(""),
        F.when(shown(source) != "", F.concat(F.lit(" - "), source)).otherwise(""),
    )
    return F.concat(head, F.lit("\n"), shown(text))


def format_context(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """query and context: the blocks of hits (rank, title, category, source, text) in order."""
    b = block(F.col("rank"), F.col("title"), F.col("category"), F.col("source"), F.col("text"))
    return hits.select(query, "rank", b.alias("b")).groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "b"))), lambda x: x["b"]), SEPARATOR).alias("context"))


def source_items(hits: DataFrame, query: str = "query_id") -> DataFrame:
    """query and sources: index from 1, title, category, source_url, doc_id, kind and referenced_by of each hit."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c if c != "source" else "source_url")
    item = F.struct(F.col("rank").cast("int").alias("index"), text("title"), text("category"), text("source"), text("doc_id"), text("kind"), F.coalesce("referenced_by", F.array().cast("array<string>")).alias("referenced_by"))
    return hits.groupBy(query).agg(F.array_sort(F.collect_list(item)).alias("sources"))


def render(item: Column) -> Column:
    """A source as lines for a terminal."""
    refs = F.when(F.size(item["referenced_by"]) > 0, F.concat(F.lit("    referenced by: "), F.array_join(item["referenced_by"], ", ")))
    head = F.concat(F.lit("["), item["index"].cast("string"), F.lit("] "), item["title"], F.when(item["category"] != "", F.concat(F.lit(" ("), item["category"], F.lit(")"))).otherwise(""))
    return F.concat_ws("\n", head, F.when(item["source_url"] != "", F.concat(F.lit("    "), item["source_url"])), refs)


def valid_question(question: Column) -> Column:
    """1 to 1000 characters before stripping, so blanks alone pass."""
    return F.coalesce(F.length(question).between(1, 1000), F.lit(False))
