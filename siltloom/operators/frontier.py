"""Breadth-first crawling, a level at a time."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import cut, delete, scratch
from .lookup import unvisited


def seeds(types: DataFrame, template: str) -> DataFrame:
    """First list page of every type: url, depth, type_id, kind and the type's order."""
    url = F.replace(F.lit(template), F.lit("{type_id}"), F.col("type_id"))
    return types.select(url.alias("url"), F.lit(0).alias("depth"), "type_id", F.lit("list").alias("kind"), F.col("type_ord"))


def crawl(start: DataFrame, expand: Callable[[DataFrame], DataFrame], visited: DataFrame | None = None, max_levels: int = 1000, limit: int | None = None) -> DataFrame:
    """Visits (seq, url, url_hash, depth, type_id, kind, level, new_links) in first-in, first-out order.

    ``start`` has url, depth, type_id, kind and type_ord. ``expand`` returns from visited rows their links:
    parent_hash, pos, url, depth, kind. A URL is visited once, by its canonical hash: of types that reach
    it in the same level, the first. A link counts as new if it wasn't visited when its page was read,
    even if it waits already, as the original queue counts. ``limit`` caps the visits of a type. A crawl
    that has pages left after ``max_levels`` says so in a warning.
    """
    spark = start.sparkSession
    root = scratch(spark, "crawl")
    hashed = lambda df: df.withColumn("url_hash", U.url_hash(F.col("url")))
    names = ("url", "url_hash", "depth", "type_id", "kind", "type_ord", "level", "pos")
    level = hashed(start).withColumn("pos", F.array(F.lit(0).cast("bigint")))
    shape = level.withColumn("level", F.lit(0)).select(*names).schema
    seen = visited.select("url_hash") if visited is not None else None
    written: list[str] = []
    spent = None
    for n in range(max_levels + 1):
        once = level.groupBy("url_hash").agg(F.min_by(F.struct("url", "depth", "type_id", "kind", "type_ord", "pos"), F.struct("type_ord", "pos")).alias("r")).select("url_hash", "r.*")
        todo = unvisited(once, seen) if seen is not None else once
        if limit is not None:
            nth = F.row_number().over(Window.partitionBy("type_id").orderBy("pos"))
            todo = todo.withColumn("nth", nth)
            todo = todo.join(spent, "type_id", "left").where(F.col("nth") + F.coalesce("used", F.lit(0)) <= limit).drop("nth", "used") if spent is not None else todo.where(F.col("nth") <= limit).drop("nth")
        todo = todo.withColumn("level", F.lit(n)).select(*names)
        if n == max_levels:
            if todo.limit(1).count():
                warnings.warn(f"the crawl stopped after {max_levels} levels with pages unread", stacklevel=2)
            break
        todo = cut(todo, f"{root}/todo-{n}")
        if todo.limit(1).count() == 0:
            break
        parents = todo.select(F.col("url_hash").alias("parent_hash"), F.col("pos").alias("parent_pos"), "type_id", "type_ord")
        links = cut(hashed(expand(todo).join(parents, "parent_hash").withColumn("pos", F.concat("parent_pos", F.array(F.col("pos").cast("bigint"))))), f"{root}/links-{n}")
        known = todo.select("url_hash") if seen is None else seen.unionByName(todo.select("url_hash"))
        counts = unvisited(links, known).groupBy("parent_hash").agg(F.count("*").alias("new_links"))
        visits = todo.join(counts, F.col("url_hash") == F.col("parent_hash"), "left").select(*names, F.coalesce("new_links", F.lit(0)).alias("new_links"))
        # a level is written once; what was read is all levels' files
        written.append(f"{root}/level-{n}")
        cut(visits, written[-1])
        delete(spark, f"{root}/todo-{n}")
        delete(spark, f"{root}/links-{n - 1}")
        done = spark.read.schema(visits.schema).parquet(*written)
        seen = done.select("url_hash") if visited is None else visited.select("url_hash").unionByName(done.select("url_hash"))
        if limit is not None:
            spent = done.groupBy("type_id").agg(F.count("*").alias("used"))
        level = links.select("url_hash", "url", "depth", "type_id", "kind", "type_ord", "pos")
    if not written:
        return spark.createDataFrame([], shape).withColumn("new_links", F.lit(0).cast("bigint"))
    return done


def page_links(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """key, pos and href of every anchor of a page, in order, by expressions alone."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("pos", "href")).withColumn("href", F.regexp_replace("href", r"^\s+|\s+$", ""))


def queue_pop(queue: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` entries that wait longest."""
    return queue.orderBy("id").limit(n)
