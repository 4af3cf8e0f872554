import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltloom import config
from siltloom.operators import bm25, context, dedup, frontier, fusion, lookup, stats, vector
from siltloom.plans import corpus, retrieve
from siltloom.sources import adapters, extract, readers, sinks
from siltloom.streaming import ingest


def test_attachment_index(spark):
    seen = spark.createDataFrame([("x", 1, "1", "u1", "p1", 5, "pdf"), ("x", 2, "2", "u2", "p2", 5, "pdf"), ("x", 3, "1", "u1", "p3", 5, "pdf"), ("y", 4, "2", "u9", "q", 7, "docx")], "checksum string, seq int, source_id string, url string, local_path string, size_bytes bigint, file_type string")
    got = {r.checksum: r for r in dedup.attachment_index(seen).collect()}
    assert (got["x"].referenced_by, got["x"].urls, got["x"].first_source_id, got["x"].local_path) == (["1", "2"], ["u1", "u2"], "1", "p1")
    more = spark.createDataFrame([("x", 9, "3", "u3", "p9", 5, "pdf"), ("z", 10, "3", "u3", "r", 1, "pdf")], seen.schema)
    up = {r.checksum: r for r in dedup.upsert_index(dedup.attachment_index(seen), more).collect()}
    assert up["x"].referenced_by == ["1", "2", "3"] and up["x"].local_path == "p1" and set(up) == {"x", "y", "z"}


def test_distinct_in_array(spark):
    df = spark.sql("SELECT array(named_struct('k', 'a', 'v', 1), named_struct('k', 'b', 'v', 2), named_struct('k', 'a', 'v', 3)) AS x")
    assert [tuple(e) for e in df.select(dedup.distinct_in_array("x", lambda e: e["k"]).alias("y")).first().y] == [("a", 1), ("b", 2)]


def test_lookups(spark):
    types = spark.createDataFrame([("1", "One")], "t string, name string")
    rows = spark.createDataFrame([(1,), (2,), (None,)], "t int")
    assert sorted(r.n for r in lookup.with_default(rows, types, "t", "name", "n").collect()) == ["2", "One", "type"]
    table = spark.createDataFrame([("a", 1)], "k string, v int")
    more = spark.createDataFrame([("a", 9), ("b", 3), ("b", 2)], "k string, v int")
    both = lookup.insert_or_ignore(table, more, "k")
    assert sorted(map(tuple, both.collect())) == [("a", 1), ("b", 2)]
    assert lookup.delete(both, table, "k").collect()[0].k == "b"
    index = spark.createDataFrame([("x", "p1"), ("y", "p2")], "checksum string, local_path string")
    files = spark.createDataFrame([("p1",)], "path string")
    seen = spark.createDataFrame([("x",), ("y",), ("z",)], "checksum string")
    assert {r.checksum: r.reused for r in lookup.reuse_or_store(seen, index, files).collect()} == {"x": True, "y": False, "z": False}


def test_crawl_order_and_counters(spark):
    links = {"http://h/L1": [("http://h/D1", "detail"), ("http://h/D2", "detail"), ("http://h/L1?page=2", "list")], "http://h/L1?page=2": [("http://h/D2", "detail"), ("http://h/D3", "detail"), ("http://h/L1?page=3", "list")]}
    edges = spark.createDataFrame([(p, i, u, k) for p, us in links.items() for i, (u, k) in enumerate(us)], "parent string, pos int, child string, kind string")

    def expand(visits):
        return visits.select("url_hash", F.col("url").alias("parent"), "depth").join(edges, "parent").select(F.col("url_hash").alias("parent_hash"), "pos", F.col("child").alias("url"), (F.col("depth") + F.when(F.col("kind") == "detail", 1).otherwise(0)).alias("depth"), "kind")

    start = spark.createDataFrame([("http://h/L1", 0, "1", "list", 1)], "url string, depth int, type_id string, kind string, type_ord int")
    got = frontier.crawl(start, expand).orderBy("level", "pos").collect()
    assert [r.url.rsplit("/", 1)[1] for r in got] == ["L1", "D1", "D2", "L1?page=2", "D3", "L1?page=3"]
    totals = stats.crawl_stats(spark.createDataFrame([(r.type_id, r.kind, True, r.new_links, False) for r in got], "type_id string, kind string, ok boolean, new_links bigint, skipped boolean")).first()
    assert (totals.processed, totals.list_pages, totals.detail_pages, totals.new_links) == (6, 3, 3, 5)
    assert frontier.crawl(start, expand, limit=4).count() == 4
    visited = spark.createDataFrame([(got[0].url_hash,)], "url_hash string")
    assert frontier.crawl(start, expand, visited).count() == 0


def okapi(docs, question, k1=1.5, b=0.75, eps=0.25):
    words = [d.split() for d in docs]
    n, avg = len(docs), sum(map(len, words)) / len(docs)
    df = {}
    for w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: eps * mean if v < 0 else v for t, v in idf.items()}
    return [sum(idf.get(q, 0) * w.count(q) * (k1 + 1) / (w.count(q) + k1 * (1 - b + b * len(w) / avg)) for q in question.split()) for w in words]


@pytest.mark.parametrize("few, sent", [(200, 1 << 25), (0, 1 << 25), (0, 0)])
def test_bm25(spark, few, sent, monkeypatch):
    """By terms sought in the files, by terms sent to every bucket, and by a join."""
    monkeypatch.setattr(bm25, "FEW", few)
    monkeypatch.setattr(bm25, "SENT_BYTES", sent)
    docs = ["a b c a", "b c d", "the the a", "", "x y z", "a a a b", "c"]
    chunks = spark.createDataFrame(list(enumerate(docs)), "chunk_id int, text string")
    asked = spark.createDataFrame([(1, "a b a"), (2, "nothing"), (3, "x the")], "query_id int, question string")
    got = bm25.top_k(bm25.build(chunks), asked, 4).orderBy("query_id", "rank").collect()
    for q, text in [(1, "a b a"), (2, "nothing"), (3, "x the")]:
        s = okapi(docs, text)
        want = sorted(range(len(docs)), key=lambda i: (-round(s[i], 12), i))[:4]
        mine = [r for r in got if r.query_id == q]
        assert [r.chunk_id for r in mine] == want
        assert [r.score for r in mine] == pytest.approx([s[i] for i in want])


def test_bm25_stored(spark, tmp_path):
    """A stored index opens again with its buckets: scores are summed without a shuffle by chunk. No table is left in the catalog."""
    docs = [f"w{i % 7} w{i % 5} common" for i in range(40)] + [None, ""]
    chunks = spark.createDataFrame(list(enumerate(docs)), "chunk_id int, text string")
    built = bm25.build(chunks, path=str(tmp_path / "index"))
    index = bm25.load(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "w1 w2 common")], "query_id int, question string")
    rows = [[tuple(r) for r in bm25.top_k(x, asked, 5).orderBy("rank").collect()] for x in (built, index)]
    assert rows[0] == rows[1] and len(rows[0]) == 5
    assert index.documents.count() == 42 and {r.dl for r in index.documents.where("chunk_id >= 40").collect()} == {0.0}
    scored = bm25.scores(index, asked)
    scored.collect()
    assert "hashpartitioning(chunk_id" not in scored._jdf.queryExecution().executedPlan().toString()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("siltloom_bm25")]


def test_bm25_blocks(spark, monkeypatch):
    """A term has a row in a block, not one in a chunk; blocks give no more than a question's k best, of copies too, and chunks of equal key count together."""
    monkeypatch.setattr(bm25, "BLOCK_BYTES", 300)
    docs = [f"w{i % 7} w{i % 5} common w{i % 7}" if i % 3 else "w1 same text" for i in range(90)]
    chunks = spark.createDataFrame(list(enumerate(docs)), "chunk_id int, text string")
    index = bm25.build(chunks)
    blocks = index.postings.where("term is null").count()
    assert 4 < blocks < 60
    assert index.postings.where("term = 'common'").count() <= blocks and index.postings.where("term = 'common'").agg({"n": "sum"}).first()[0] == 60
    asked = spark.createDataFrame([(1, "w1 w1 same"), (2, "w3 common"), (3, "unknown")], "query_id int, question string")
    got = bm25.top_k(index, asked, 4).orderBy("query_id", "rank").collect()
    for q, text in [(1, "w1 w1 same"), (2, "w3 common"), (3, "unknown")]:
        s = okapi(docs, text)
        want = sorted(range(len(docs)), key=lambda i: (-round(s[i], 9), i))[:4]
        mine = [r for r in got if r.query_id == q]
        assert [r.chunk_id for r in mine] == want and [r.score for r in mine] == pytest.approx([s[i] for i in want])
    assert [r.chunk_id for r in bm25.top_k(index, asked.where("query_id = 3"), 2).orderBy("rank").collect()] == [0, 1]
    s, ids = np.array([1.0] * 50 + [2.0] * 2 + [1.0 + 1e-12] * 50), np.arange(102)
    assert sorted(bm25._met(s, s > 0, ids[::-1].copy(), 4)) == [46, 47, 48, 49, 50, 51, 98, 99, 100, 101]
    twice = bm25.build(chunks.union(chunks.where("chunk_id = 1")))
    both = {r.chunk_id: r.score for r in bm25.scores(twice, asked.where("query_id = 2")).collect()}
    assert both[1] == pytest.approx(2 * okapi([*docs, docs[1]], "w3 common")[1])


def test_bm25_negative(spark):
    """Where terms of most chunks make the mean negative, chunks without a hit come first."""
    docs = ["a a", "a", "a a a b", "a c"]
    chunks = spark.createDataFrame(list(enumerate(docs)), "chunk_id int, text string")
    asked = spark.createDataFrame([(1, "a")], "query_id int, question string")
    index = bm25.build(chunks.where("chunk_id < 2"))
    assert index.least_idf < 0
    got = bm25.top_k(index, asked, 2).orderBy("rank").collect()
    s = okapi(docs[:2], "a")
    assert [r.chunk_id for r in got] == sorted(range(2), key=lambda i: (-s[i], i))
    assert [r.score for r in got] == pytest.approx(sorted(s, reverse=True))


@pytest.mark.parametrize("metric", vector.METRICS)
def test_vector_search(spark, metric, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(97, None), (98, [1.0, 2.0]), (99, [0.0] * 6)]
    vectors = spark.createDataFrame(rows, "chunk_id int, embedding array<double>")
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in (0, 7, 9)] + [(5, None)], "query_id int, q_embedding array<double>")
    monkeypatch.setattr(vector, "QUESTION_BLOCK", 2)
    got = {(r.query_id, r["rank"]): r for r in vector.search(vectors, asked, 5, metric).collect()}
    assert len(got) == 15
    full = np.vstack([x, np.zeros(6)]) if metric != "cosine" else x
    for q in (0, 7, 9):
        s = vector._scores(x[[q]], full, metric)[0]
        top = np.argsort(-s, kind="stable")[:5]
        assert [got[q, k + 1].score for k in range(5)] == pytest.approx(s[top].tolist())
        near = vector.nearest(vectors.where("size(embedding) = 6 and chunk_id < 60"), x[q].tolist(), 5, metric).collect()
        assert [r.chunk_id for r in near][0] == int(np.argmax(vector._scores(x[[q]], x, metric)[0]))


def test_fusion(spark):
    v = spark.createDataFrame([(1, 1, 0.9, "A", 1), (1, 2, 0.5, "B", 2), (1, 3, 0.4, "A", 3)], "query_id int, rank int, score double, text string, id int")
    w = spark.createDataFrame([(1, 1, 7.0, "C", 4), (1, 2, 6.0, "B", 5)], "query_id int, rank int, score double, text string, id int")
    got = fusion.fuse(v, w).orderBy("rank").collect()
    assert [(r.text, r.doc.id) for r in got] == [("A", 3), ("B", 2), ("C", 4)]
    assert [r.score for r in got] == pytest.approx([0.845, 0.5, 0.35])
    best = fusion.rerank(fusion.fuse(v, w), adapters.overlap_score(F.lit("c b"), F.col("text")), 3, 2).orderBy("rank").collect()
    assert [r.text for r in best] == ["B", "C"]


def test_context(spark):
    hits = spark.createDataFrame([(1, 2, "T2", None, "", "y", "d2", "news", None), (1, 1, "T1", "C", "u", "x", "d1", "news", ["r"])], "query_id int, rank int, title string, category string, source string, text string, doc_id string, kind string, referenced_by array<string>")
    assert context.format_context(hits).first().context == "[1] T1 (C) - u\nx\n\n---\n\n[2] T2\ny"
    items = context.source_items(hits).first().sources
    assert [(i["index"], i.title, i.source_url, i.referenced_by) for i in items] == [(1, "T1", "u", ["r"]), (2, "T2", "", [])]
    lines = context.source_items(hits).select(F.transform("sources", context.render).alias("l")).first().l
    assert lines[0] == "[1] T1 (C)\n    u\n    referenced by: r" and lines[1] == "[2] T2"


def docx(path, paragraphs, table):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in paragraphs)
    t = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in table)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:tbl>{t}</w:tbl>{p}</w:body></w:document>')


def test_extraction(tmp_path):
    docx(tmp_path / "a.docx", ["one", " ", "two"], [["a", "b"], ["", ""]])
    data = (tmp_path / "a.docx").read_bytes()
    assert extract.extract("A.DOCX", data) == "one\ntwo\na | b"
    assert extract.extract("a.docx", b"broken") is None and extract.extract("a.xls", b"x") is None and extract.extract("a.md", b"x") == "x" and extract.extract(None, None) is None
    text = lambda a, b: {(0, 10): "top", (20, 100): "end"}.get((a, b), "")
    assert extract.layout_page(100, [(21, 22, [["z"]]), (10, 20, [["a", None]])], lambda a, b: {(0.0, 10): "top", (22, 100): "end"}.get((a, b), "")) == "top\na\nz\nend" and text(0, 10)
    assert extract.within(1, __import__("time").sleep, 5) is None


def test_retry():
    calls = []

    def fetch(url):
        calls.append(url)
        if len(calls) == 1:
            raise OSError
        return (503, b"") if len(calls) == 2 else (200, b"ok")

    assert adapters.with_retry(fetch, 3, 0, sleep=lambda _: None)("u") == (200, b"ok") and len(calls) == 3


def test_fetch_pages(spark):
    urls = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")

    def fetch(u):
        if u == "c":
            raise OSError("down")
        return (200, u.encode()) if u == "a" else (404, b"")

    got = {r.url: (r.status, r.error) for r in adapters.fetch_pages(urls, fetch).collect()}
    assert got == {"a": (200, None), "b": (404, "HTTP 404"), "c": (None, "down")}


@pytest.fixture
def raw(tmp_path):
    root = tmp_path / "raw"
    (root / "news/cat").mkdir(parents=True)
    article = lambda i, **k: (root / f"news/cat/{i}.json").write_text(json.dumps({"source_id": str(i), "type_id": "1", "url": f"http://h/{i}", "title": f" T{i} ", "category": "C", "content_html": "", "content_text": "", **k}))
    article(1, content_html="<body><p>Hello</p><p>world 1 2</p></body>")
    article(2, content_text="plain text\n\n7")
    article(3)
    article(4, content_html="<div>x</div>", title=None)
    (root / "news/cat/5.json").write_text("{broken")
    (root / "attachments").mkdir()
    docx(root / "attachments/f.docx", ["attached"], [])
    (root / "attachments_index.json").write_text(json.dumps({"abcdef0123456789": {"checksum": "abcdef0123456789", "local_path": "data/f.docx", "file_type": "docx", "urls": ["u1"], "referenced_by": ["1"], "first_source_id": "1", "size_bytes": 3}, "other": {"local_path": "gone.docx", "file_type": "docx"}, "xls": {"local_path": "f.docx", "file_type": "xls"}}))
    (root / "external_files").mkdir()
    (root / "external_files/one.txt").write_text("external text")
    (root / "external_files/download_log.json").write_text(json.dumps({"sharepoint": {"http://s/1": {"status": "ok", "file": "one.txt", "title": "E", "source_id": "9"}, "http://s/2": {"status": "skipped", "file": "one.txt"}}, "google_drive": {"http://g/1": {"status": "failed", "reason": "x"}}, "stats": {}}))
    return root


def test_corpus_and_index(spark, raw, tmp_path):
    out, index = str(tmp_path / "clean"), str(tmp_path / "index")
    manifest = {r.kind: r.documents for r in corpus.build_corpus(spark, f"file://{raw}", f"file://{out}").collect()}
    assert manifest == {"news": 3, "attachment": 1, "external": 1, None: 5}
    docs = readers.cleaned(spark, f"{out}/documents", lines=True)
    by = {r.doc_id: r for r in docs.collect()}
    assert by["news-1"].content == "Hello world 12" and by["news-2"].content == "plain text" and by["news-4"].title == ""
    assert by["att-abcdef012345"].content == "attached" and by["ext-one"].source_url == "http://s/1"
    log = readers.download_log(spark, f"file://{raw}/external_files/download_log.json")
    assert {(r.provider, r.status): r.n for r in stats.status_counts(log, "provider", "status").collect()} == {("sharepoint", "ok"): 1, ("sharepoint", "skipped"): 1, ("google_drive", "failed"): 1}
    embedder = adapters.HashingEmbedder(16)
    assert corpus.build_index(docs, index, "c1", embedder, dry_run=True).first().n == 5
    corpus.build_index(docs, index, "c1", embedder)
    corpus.build_index(docs, index, "c1", embedder)
    assert readers.collection(spark, index, "c1").count() == 10
    corpus.build_index(docs, index, "c1", embedder, clear=True)
    corpus.build_index(docs, index, "c2", embedder)
    assert readers.collection(spark, index, "c1").count() == 5
    assert tuple(corpus.status(spark, index).first()) == ("ok", 10) and corpus.status(spark, f"{index}-none").first().status == "degraded"
    chunks = readers.collection(spark, index, "c1").select("chunk_id", "text", "embedding", "meta.*")
    asked = spark.createDataFrame([(1, " hello world "), (2, ""), (3, "external text")], "query_id int, question string")
    asked = adapters.embed(asked, "question", embedder, "q_embedding")
    got = {r.query_id: r for r in retrieve.answer(asked, chunks).collect()}
    assert set(got) == {1, 3} and got[1].answer == "Hello world 12" and got[3].sources[0].doc_id == "ext-one"
    plain = config.Config(reranker=config.Rerank(enabled=False))
    assert retrieve.retrieve(asked.where("query_id = 1"), chunks, plain).count() == 5


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "snap")
    assert sinks.read_snapshot(spark, path, "a int").count() == 0
    sinks.snapshot(spark.createDataFrame([(1,)], "a int"), path)
    sinks.snapshot(spark.createDataFrame([(2,)], "a int"), path)
    assert [r.a for r in sinks.read_snapshot(spark, path, "a int").collect()] == [2]
    rows = spark.createDataFrame([("c", "1", "old", "2020"), ("c", "1", "new", "2021"), ("d", "1", "x", "2020")], "category_slug string, source_id string, title string, crawled_at string")
    sinks.news(rows, str(tmp_path / "news"))
    sinks.news(rows.where("category_slug = 'd'").withColumn("title", F.lit("y")), str(tmp_path / "news"))
    assert sorted((r.category_slug, r.title) for r in spark.read.json(str(tmp_path / "news")).collect()) == [("c", "new"), ("d", "y")]


def test_streaming(spark, raw, tmp_path):
    source, out = f"{raw}/news", str(tmp_path / "out")
    query = ingest.start(ingest.articles(spark, source), out, str(tmp_path / "ck"))
    query.awaitTermination(60)
    first = spark.read.parquet(out).count()
    (raw / "news/cat/9.json").write_text((raw / "news/cat/1.json").read_text())
    query = ingest.start(ingest.articles(spark, source), out, str(tmp_path / "ck"))
    query.awaitTermination(60)
    assert first >= 1 and spark.read.parquet(out).count() == first


def test_config(tmp_path, monkeypatch):
    (tmp_path / "retrieval.yaml").write_text("vector: {top_k: '7'}\nfusion: {vector_weight: 1}\nfinal_top_k: 3\nmode: hybrid\n")
    (tmp_path / "crawl.yaml").write_text("base_url: http://h\nretry: {max_attempts: 5}\ncrawler: {hash_length: 8}\n")
    got = config.load(str(tmp_path))
    assert (got.retrieval.vector_top_k, got.retrieval.vector_weight, got.retrieval.final_top_k, got.crawl.max_attempts, got.crawl.hash_length) == (7, 1.0, 3, 5, 8)
    assert config.load() == config.Config() and got.chunking == config.Chunking()
    monkeypatch.setenv("DB_HOST", "db")
    assert config.database_url() == "jdbc:postgresql://db:5432/rag"
    with pytest.raises(FileNotFoundError):
        config.load_yaml(str(tmp_path / "no.yaml"))


def test_downloads(spark):
    from siltloom.sources import downloads

    links = spark.createDataFrame([("google_drive", "https://d/file/d/Q/a.pdf", "1", "c", "t" * 80), ("sharepoint", "http://s/old.pdf", "2", "c", "x"), ("sharepoint", "http://s/web.pdf", "3", "c", "x"), ("sharepoint", "http://s/down.pdf", "4", "c", "x")], "provider string, url string, source_id string, category string, title string")
    listing = spark.createDataFrame([("2_old.pdf", 5000), ("4_down.pdf", 10)], "file_name string, length bigint")

    def fetch(url):
        if "down" in url:
            raise OSError("down")
        return 200, (b"<html>" if "web" in url else b"%PDF") + b"x" * 2000

    planned = downloads.plan(links, listing)
    assert {r.source_id: r.file_id for r in planned.collect()}["1"] == "Q"
    got = {r.source_id: r for r in downloads.download(planned, fetch).collect()}
    assert {k: (r.status, r.reason) for k, r in got.items()} == {"1": ("ok", None), "2": ("skipped", None), "3": ("failed", "not a file"), "4": ("failed", "down")}
    assert got["1"].size == 2004 and len(got["1"].title) == 60 and got["1"].file == "1_a.pdf" and got["3"].content is None


def test_json_and_base_urls(spark):
    from siltloom.functions import urls

    row = sinks.as_json(spark.sql("SELECT timestamp'2024-01-02 03:04:05' AS t, array(named_struct('u', 'é')) AS a")).first()
    assert json.loads(row.value) == {"t": "2024-01-02T03:04:05", "a": [{"u": "é"}]}
    assert spark.range(1).select(urls.with_slash(F.lit("http://h//"))).first()[0] == "http://h/"


def test_command_line(spark, raw, tmp_path, capsys):
    from siltloom.__main__ import main

    clean, index = str(tmp_path / "c"), str(tmp_path / "i")
    assert {r.kind for r in main(["clean", f"file://{raw}", clean])} == {"news", "attachment", "external", None}
    assert main(["index", clean, index, "--dry-run"])[0].n == 5
    main(["index", clean, index, "--clear"])
    assert main(["status", index])[0].chunks == 5
    assert "external text" in main(["ask", index, "external", "text"])[0].answer
