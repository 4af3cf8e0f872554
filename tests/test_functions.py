"""The functions against written-out cases and independent statements in Python."""

import random

import pytest
from pyspark.sql import functions as F

from siltloom.functions import chunk, dates, html, register, text, urls

CLEAN = [
    ("Kế hoạch số 61 /KH- ĐNT", "Kế hoạch số 61/KH- ĐNT"), ("10 000 000 đồng", "10000000 đồng"), ("Ngày 5 10", "Ngày 510"), ("1 2 3 4", "1234"),
    ("A\xa0\xa0B", "A B"), ("a\n\n\nb", "a\nb"), ("abc\nabc\nabcd\nabcd", "abc\nabcd\nabcd"), ("12\n123\n7", "123"), ("été", "\xe9t\xe9"),
    ("xem TẠI ĐÂY nhé", "nhé"), ("Xem chi tiết tại đây", "Xem chi tiết"), ("<<Vui lòng xem TẠI ĐÂY>>", ""), ("“Hi” – ok…", '"Hi" - ok...'),
    ("x​y", "x​y"), ("1 | 2\n-\n|\nA | B", "1 | 2\nA | B"), (" · ", ""), ("", ""), ("\n \n", ""), (None, None),
]


def one(spark, rows, expr, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, " + schema)
    return [r.out for r in df.select("i", expr.alias("out")).orderBy("i").collect()]


def cleaned(spark, rows, **options):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, v string")
    return [r.out for r in text.clean_text(df, "v", "out", **options).orderBy("i").collect()]


def in_sql(spark, rows, function):
    register.register(spark)
    df = spark.createDataFrame(list(enumerate(rows)), "i int, v string")
    return [r.out for r in spark.sql(f"SELECT {function}(v) AS out FROM {{df}} ORDER BY i", df=df).collect()]


def test_clean_text_cases(spark):
    assert cleaned(spark, [c[0] for c in CLEAN]) == [c[1] for c in CLEAN]
    assert in_sql(spark, [c[0] for c in CLEAN], "clean_text") == [c[1] for c in CLEAN]
    assert cleaned(spark, ["x​y"], zero_width="intent") == ["xy"]
    with pytest.raises(ValueError):
        text.replace_chars(F.lit("x"), "other")


def test_clean_text_on_random_texts(spark):
    rnd = random.Random(7)
    bits = ["xem tại đây", "TẠI ĐÂY", "<<a>>", "\n", "\n", " ", "\t", " / ", "1", "23", "٣", "é", "é", "\xa0", "\x1c", " ", "·", "-", "|", "…", "abc", "Đ", "​", ".", "\x85", "tải về tại đây"]
    rows = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(1500)]
    assert cleaned(spark, rows) == in_sql(spark, rows, "clean_text")


def test_slugify(spark):
    rows = ["Quy định - Quy chế", "Thông báo Phòng Khảo thí - Bảo đảm chất lượng giáo dục", "!!!", None, " a_b  c-- "]
    assert one(spark, rows, text.slugify(F.col("v"))) == ["quy-định-quy-chế", "thông-báo-phòng-khảo-thí-bảo-đảm-chất-lư", "uncategorized", "uncategorized", "a-b-c"]


def test_tables_and_bytes(spark):
    rows = [[["a", None, "b  c"], [" ", None], ["x"]]]
    assert one(spark, rows, text.format_table(F.col("v")), "v array<array<string>>") == [["a |  | b c", "x"]]
    assert one(spark, [bytearray("é".encode()), bytearray(b"\xe9")], text.decode_bytes(F.col("v")), "v binary") == ["é", "é"]


URLS = [
    "HTTP://Ex.com?b=2&a=1&c=#x", "http://ex.com/p?q=a b", "http://ex.com/P;z=1?b&a=%C3%A9", "http://ex.com/a*?k=*~", "https://U:P@h.org:8080/x/?z=1&a=2&a=1", "http://h", "http://h/?q=1%2B1&r=+",
]


def test_canonical_urls(spark):
    got = one(spark, URLS, urls.canonicalize(F.col("v")))
    assert got == in_sql(spark, URLS, "canonicalize_url") == [
        "http://ex.com/?a=1&b=2", "http://ex.com/p?q=a+b", "http://ex.com/P;z=1?a=%C3%A9", "http://ex.com/a*?k=%2A~", "https://u:p@h.org:8080/x/?a=1&a=2&z=1", "http://h/", "http://h/?q=1%2B1&r=+",
    ]
    assert one(spark, URLS[:4], urls.url_hash(F.col("v"))) == ["9deb11cd037e25ed", "4f8412fdba312e04", "ab6ef0405549f27d", "f855bb687f844f61"]
    assert one(spark, got, urls.canonicalize(F.col("v"))) == got
    assert one(spark, URLS[:1], urls.url_hash(F.col("v"), "nonsense", None)) == one(spark, URLS[:1], urls.url_hash(F.col("v"), "md5", None))


def test_url_joins(spark):
    from urllib.parse import urljoin

    base = "http://h.com/a/b?q=1#f"
    hrefs = ["x", "/x/y", "../x", "./x", "?p=2", "#top", "//o.org/z", "https://z.de/q", "../../../x", "x?y=1#z", "..", ""]
    want = [urljoin(base, h) for h in hrefs]
    got = one(spark, hrefs, urls.join(F.lit(base), F.col("v")))
    assert [g for g, h in zip(got, hrefs) if h] == [w for w, h in zip(want, hrefs) if h]


def test_url_kinds(spark):
    assert one(spark, ["/News/Type/3", "/News/Detail/9/x", "/z"], urls.classify(F.col("v"))) == ["list", "detail", "other"]
    assert one(spark, ["http://a/b", "http://a/b?page=9&x=1", "http://a/b?x=1"], urls.next_page(F.col("v"))) == ["http://a/b?page=2", "http://a/b?page=10&x=1", "http://a/b?x=1&page=2"]
    assert one(spark, ["a.PDF", "a.pdf?v=1", "#a.pdf", "mailto:a.zip", "", "x.docx"], urls.is_attachment(F.col("v"))) == [True, False, False, False, False, True]
    assert one(spark, ["/News/Detail/5", "/News/Detail/5/t", "http://x/News/Detail/5", "/News/Detail/5?x"], urls.is_detail_link(F.col("v"))) == [True, True, False, False]
    assert one(spark, ["unknown", "pdf", "weird"], urls.resolve_extension(F.col("v"), F.lit("application/zip"))) == ["zip", "pdf", "zip"]
    assert one(spark, ["a.bin", "b", "c.PDF"], urls.with_extension(F.col("v"), F.lit("pdf"))) == ["a.pdf", "b.pdf", "c.PDF"]
    names = ["http://h/x/My%20File%3F.docx", "http://h/", "http://h/ab", "http://h/" + "n" * 80 + ".zip"]
    assert one(spark, names, urls.safe_filename(F.col("v"), F.lit("7"), F.lit(2))) == ["7_My File_.docx", "7_file_7_2.pdf", "7_file_7_2.pdf", "7_" + "n" * 60 + ".zip"]
    assert one(spark, ["https://d/file/d/AbC/view"], urls.drive_file_id(F.col("v"))) == ["AbC"]
    assert one(spark, [bytearray(b"<!DOCTYPE HTML>" + b"x" * 2000), bytearray(b"%PDF" + b"x" * 2000), bytearray(b"x")], urls.is_html_reply(F.col("v")), "v binary") == [True, False, True]


def test_dates(spark):
    rows = [["x", "on 31/02/2024", "at 5-3-2024 7/7/2020"], ["1/13/2020"], []]
    assert [str(d) if d else None for d in one(spark, rows, dates.sniff_date(F.col("v")), "v array<string>")] == ["2024-03-05 00:00:00", None, None]


HTML = [
    ("<div><p>A</p><p>B</p></div>", "A B", "A\nB"), ("<div>x<!-- c -->y</div>", "x c y", "x c y"), ("<div><span><p>A</p><p>B</p></span></div>", "A B", "A B"),
    ("<div>Kế hoạch <span>61</span><span>/KH</span></div>", "Kế hoạch 61/KH", "Kế hoạch 61 /KH"), ("<div>a<p>b<p>c<br>d</div>", "a b c d", "a\nb\nc\nd"),
    ("<div>one<br>two<br/>three</div>", "one two three", "one\ntwo\nthree"), ("<div>a<span>b<br>c</span>d</div>", "a b c d", "a b c d"),
    ("<div>a<main>b</main><aside>c</aside>d<address>e</address></div>", "a b c d e", "a b c d e"), ("<p>x<br>y</p>", "x y", "x\ny"), ("<b>x<br>y</b>", "x y", "x y"),
]


def test_html(spark):
    df = spark.createDataFrame([(i, h[0]) for i, h in enumerate(HTML)], "i int, v string")
    assert [r.out for r in html.clean_html(df, "v", "out").orderBy("i").collect()] == [h[1] for h in HTML]
    assert one(spark, [h[0] for h in HTML], html.block_text(F.col("v"))) == [h[2] for h in HTML]
    page = "<html><head><style>s</style></head><BODY class='x'><nav>N</nav>T&amp;U&nbsp;V<script>if (a<b) {}</script><footer>F</footer></BODY></html>"
    df = spark.createDataFrame([(0, page), (1, None), (2, "")], "i int, v string")
    assert [r.out for r in html.clean_html(df, "v", "out").orderBy("i").collect()] == ["T&U V", "", ""]
    assert html.clean_html(spark.createDataFrame([("a<!-- c -->b",)], "v string"), "v", "out", keep_comments=False).first().out == "a b"


def test_page_facts():
    page = """<body><nav><a href='/n'>n</a></nav><a class="title_topicdisplay x"> The <b>title</b></a>
    <div class='divmain'><div class='bgtitle'>bg</div><form>f</form><p>one</p><p>two <a href=' /f.pdf '>file</a></p><div class='share'>s</div></div><i>12/05/2023</i></body>"""
    f = html.page_facts(page)
    assert f["title"] == "The title" and f["content_text"] == "one\ntwo file" and f["links"] == [{"href": "/f.pdf", "text": "file"}]
    assert "12/05/2023" in f["nodes"] and html.page_facts(None) is None


def reference_split(content, size, overlap, marks):
    """The splitting rules written out once more, without sharing code."""
    mark, finer = marks[-1], []
    for k, m in enumerate(marks):
        if m in content:
            mark, finer = m, marks[k + 1 :]
            break
    parts = content.split(mark)
    parts = [p for p in [parts[0]] + [mark + p for p in parts[1:]] if p]

    def pack(ps):
        out, buf, total = [], [], 0
        for p in ps:
            if total + len(p) > size and buf:
                joined = "".join(buf).strip()
                out += [joined] if joined else []
                while total > overlap or (total + len(p) > size and total > 0):
                    total -= len(buf.pop(0))
            buf.append(p)
            total += len(p)
        joined = "".join(buf).strip()
        return out + ([joined] if joined else [])

    out, good = [], []
    for p in parts:
        if len(p) < size:
            good.append(p)
        else:
            out += pack(good)
            good = []
            out += reference_split(p, size, overlap, finer) if finer else [p]
    return out + pack(good)


def test_chunks():
    rnd = random.Random(5)
    for _ in range(300):
        content = "".join(rnd.choice(["a", "bcd", " ", ". ", "\n", "\n\n", "\n## ", "xyzw" * 3]) for _ in range(rnd.randint(0, 200)))
        got = chunk.split_text(content, 60, 12)
        assert got == reference_split(content, 60, 12, list(chunk.SEPARATORS))
        assert all(c and c in content and (c == c.strip() or len(c) >= 60) for c in got)
        assert all(len(c) <= 60 or " " not in c.strip() for c in got)
    assert chunk.split_text("a" * 1500) == ["a" * 1500]


def test_explode_chunks(spark):
    docs = spark.createDataFrame([(1, "word " * 600), (2, ""), (3, None)], "doc_id int, content string")
    rows = chunk.explode_chunks(docs).orderBy("chunk_pos").collect()
    assert [r.chunk for r in rows] == chunk.split_text("word " * 600) and {r.doc_id for r in rows} == {1}
    with pytest.raises(ValueError):
        chunk.chunk_udf(10, 20)


def test_sql_functions(spark):
    register.register(spark)
    row = spark.sql("SELECT clean_text('1 2 3') AS a, clean_html('<body><nav>n</nav><p>x</p>y</body>') AS b, chunk_text('hi') AS c, canonicalize_url('HTTP://A') AS d, url_hash('http://a/') AS e, cosine(array(1D, 0D), array(1D, 1D)) AS f").first()
    assert (row.a, row.b, row.c, row.d) == ("123", "x y", ["hi"], "http://a/") and len(row.e) == 16 and row.f == pytest.approx(0.70710678)


def test_references_without_a_semicolon(spark, tmp_path):
    # html_to_text and page_facts decode only those that end in one, as their SQL does; the functions decode both unless told otherwise
    import duckdb

    import __spark_entry__ as entry

    bodies = ["a&amp;b", "a&amp &amp;", "&am", "cut &quo", "&copy &copy; &amp;copy", "<b>x&ltb</b>", "&&amp;&", "<p title='&amp'>&amp</p>", "&notit; no"]
    pages = [(i, "http://h/", f"<html><body><p>{b}</p></body></html>") for i, b in enumerate(bodies)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("html_to_text", "page_facts"):
        got = entry.queries()[name](spark, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(con.sql(entry.oracle_sql()[name]).fetchall()), name
    assert [r.out for r in html.clean_html(df.where("page_id in (1, 8)"), "html", "out").orderBy("page_id").collect()] == ["a& &", "¬it; no"]
    assert html.decode_closed("&#38; &#x26; &#38 &amp") == "& & &#38 &amp"
    link = html.page_facts('<body><a href="?a=1&copy">k</a><!-- x&amp --></body>', open_references=False)
    assert link["links"] == [{"href": "?a=1&copy", "text": "k"}] and " x&amp " in link["nodes"]


def test_python_holds_few_rows_at_once(spark, sf_dir):
    import pyarrow as pa

    from siltloom.plans.registry import table

    keys = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    old = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, ("10000", "64m")):
            spark.conf.set(k, v)
        table(spark, sf_dir, "documents")

        @F.arrow_udf("long")
        def held(v: pa.Array) -> pa.Array:
            return pa.array([len(v)] * len(v), pa.int64())

        short, long = (spark.range(3000, numPartitions=1).select(held(F.repeat(F.lit("x"), n)).alias("n")).agg(F.max("n")).first()[0] for n in (1, 100_000))
        assert short <= 512 and long <= 64
        spark.conf.set(keys[0], "7")
        table(spark, sf_dir, "documents")
        assert spark.conf.get(keys[0]) == "7"
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)


def test_inline_junk_is_sought_where_its_letters_are(spark):
    # each phrase is guarded, and what is left equals removal of all phrases in turn, also where a removal makes another phrase
    import re

    rng = random.Random(8)
    bits = [*text.INLINE_JUNK, "VUI LÒNG CLICK", "Ấ", "đ", "vui lòng ", "xem ", "tại ", "đây", "chi tiết ", "lòng", "x", " ", "abc"]
    rows = ["".join(rng.choice((b, b.upper(), b[: rng.randrange(1, len(b) + 1)])) for b in rng.choices(bits, k=6)) for _ in range(400)]
    rows += ["vui lTẠI ĐÂYòng click", "xem tTẠI ĐÂYại đây", "plain", "", None]

    def want(t):
        for p in text.INLINE_JUNK:
            t = re.sub(re.escape(p), "", t, flags=re.I)
        return t

    df = spark.createDataFrame(list(enumerate(rows)), "i int, v string")
    out = df.select("i", text.remove_inline_junk(F.col("v")).alias("out"))
    assert [r.out for r in out.orderBy("i").collect()] == [None if t is None else want(t) for t in rows]
    assert "contains" in out._jdf.queryExecution().optimizedPlan().toString().lower()
