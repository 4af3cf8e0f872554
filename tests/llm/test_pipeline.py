import corpus_pipeline
from pyspark.sql import functions as F

from siltloom.llm import minhash, secrets, toxicity
from siltloom.llm.queries import table


def test_stages_on_the_smallest_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "secret_scan", "mixing", "bpe"]
    stage = dict(corpus_pipeline.STAGES)
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    rows = {r.doc_id: r.text for r in docs.collect()}
    clean = stage["toxicity"](spark, docs, sf_dir).cache()
    assert {r.doc_id for r in clean.collect()} == {i for i, t in rows.items() if model.score(t) < 0.5}
    unique = stage["near_dedup"](spark, clean, sf_dir).cache()
    brute = minhash.brute_force([(r.doc_id, r.text) for r in clean.collect()], 5, 80)
    assert {r.doc_id for r in unique.collect()} == {i for i, _, _, kept in brute if kept}
    safe = stage["secret_scan"](spark, unique, sf_dir).cache()
    assert safe.columns == docs.columns and safe.count() == unique.count()
    assert secrets.scan_paths(safe).where(F.size("spans") > 0).count() == 0
    assert safe.where(F.length("text") != F.col("n_chars")).count() == 0
    mixed = stage["mixing"](spark, safe, sf_dir).cache()
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in safe.collect()}
    out = stage["bpe"](spark, mixed, sf_dir)
    assert out.count() == mixed.count()


def test_stages_on_edge_cases(spark, sf_dir, edge_docs):
    """Every column of the edge cases, clashing ones included, comes back as it was."""
    docs, before = edge_docs, {}
    rest = [c for c in edge_docs.columns if c not in ("text", "n_chars")]
    for r in edge_docs.select(rest).collect():
        before.setdefault(r.doc_id, set()).add(tuple(r))
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, sf_dir).cache()
        assert docs.schema == edge_docs.schema
        assert all(tuple(r) in before[r.doc_id] for r in docs.select(rest).collect())
    assert {r.doc_id for r in docs.collect()} >= {1, 2, 3, 4, 5, 8, 11}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, edge_docs.limit(0), sf_dir).count() == 0


def test_core_queries_without_what_the_rest_needs(monkeypatch):
    import sys

    import __spark_entry__ as entry

    whole = set(entry.queries())
    for name in [n for n in sys.modules if n.startswith(("siltloom.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "zstandard", None)
    core = set(entry.queries())
    assert core and whole - core == {"pipeline", *(n for n in whole if n.startswith("op"))}
    assert set(entry.oracle_sql()) <= core


def test_near_dedup_recall_by_similarity(spark):
    """Edited copies at and about the threshold: the class is what brute force over all pairs says."""
    import random

    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(60):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(40, 160))]
        rows.append(base)
        for _ in range(3):
            copy = list(base)
            for _ in range(rnd.randint(1, max(2, len(base) // 30))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append(copy)
    rnd.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs).collect())
    assert got == sorted(minhash.brute_force(rows, 5, 80))
    assert 60 < sum(r[3] for r in got) < 240
