"""python -m siltloom clean|index|ask|status: the offline jobs and questions from a shell."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from . import config
from .operators import context
from .plans import corpus, retrieve
from .session import build
from .sources import adapters, readers

COLLECTION = "main"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltloom")
    p.add_argument("--config", help="folder of YAML files")
    job = p.add_subparsers(dest="job", required=True)
    clean = job.add_parser("clean")
    clean.add_argument("root")
    clean.add_argument("out")
    clean.add_argument("--limit", type=int)
    index = job.add_parser("index")
    index.add_argument("clean")
    index.add_argument("out")
    index.add_argument("--limit", type=int)
    index.add_argument("--dry-run", action="store_true")
    index.add_argument("--clear", action="store_true")
    ask = job.add_parser("ask")
    ask.add_argument("index")
    ask.add_argument("question", nargs="+")
    status = job.add_parser("status")
    status.add_argument("index")
    return p


def main(argv: list[str] | None = None) -> list:
    """Runs a job; prints and returns its rows."""
    args = parser().parse_args(argv)
    spark, settings = build(), config.load(args.config)
    embedder = adapters.HashingEmbedder(settings.embedding.dim)
    if args.job == "clean":
        out = corpus.build_corpus(spark, args.root, args.out, settings, args.limit)
    elif args.job == "index":
        docs = readers.cleaned(spark, f"{args.clean}/documents", lines=True)
        out = corpus.build_index(docs, args.out, COLLECTION, embedder, settings, args.clear, args.dry_run, args.limit)
    elif args.job == "status":
        out = corpus.status(spark, args.index)
    else:
        asked = spark.createDataFrame([(1, " ".join(args.question))], "query_id int, question string")
        chunks = readers.collection(spark, args.index, COLLECTION).select("chunk_id", "text", "embedding", "meta.*")
        answers = retrieve.answer(adapters.embed(asked, "question", embedder, "q_embedding"), chunks, settings)
        out = answers.select(F.array_join(F.concat(F.array("answer"), F.transform("sources", context.render)), "\n").alias("answer"))
    rows = out.collect()
    for row in rows:
        print(*(v for v in row), sep="\t")
    return rows


if __name__ == "__main__":
    main()
