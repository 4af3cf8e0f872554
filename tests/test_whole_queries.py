"""Queries that must ask every question of the stated set, or search every document."""

import numpy as np
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name, metric, least", [("topk_cosine", "cosine", None), ("topk_l2", "l2", None), ("topk_inner", "inner", None), ("threshold", "cosine", 0.25)])
def test_every_question_is_asked(spark, sf_dir, name, metric, least):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    want = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = {"inner": x @ x[q], "l2": -np.linalg.norm(x - x[q], axis=1), "cosine": x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q])}[metric]
        best = np.lexsort((ids, -s))[:25]
        want |= {(int(ids[q]), k + 1): (int(ids[i]), s[i]) for k, i in enumerate(best) if least is None or s[i] >= least}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in entry.queries()[f"vector_{name}"](spark, sf_dir).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert len({k[0] for k in got}) == (ids % 20 == 0).sum() > 1
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


@pytest.mark.parametrize("name", ["hybrid_fuse", "context_format", "source_items", "rerank_overlap"])
def test_documents_without_an_embedding_are_found(spark, tmp_path, name):
    texts = ["alpha beta", "gamma delta", "filler one", "filler two", "filler three", "needle thread", "needle eye"]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0, "needle"), (5, "thread")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = entry.queries()[name](spark, str(tmp_path)).collect()
    assert {r.query_id for r in rows} == {0, 5}
    if name == "context_format":
        import duckdb

        con = duckdb.connect()
        for t in ("documents", "embeddings", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        assert {(r.query_id, r.digest) for r in rows} == set(con.sql(entry.oracle_sql()[name]).fetchall())
    else:
        found = {(r.query_id, str(r.doc_id).removeprefix("doc-")) for r in rows}
        assert {(0, "5"), (0, "6"), (5, "5")} <= found
