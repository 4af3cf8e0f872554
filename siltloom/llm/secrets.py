"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger has, for each scan, a row per
blob with the (rule, version) pairs that were scanned and the findings with theirs; only blobs with an
unseen pair are scanned, once however many paths hold them, and only for the rules they haven't seen.
Findings belong to blobs and are joined back to every path. Those of superseded versions stay in the
ledger and aren't reported.

A scan is one folder that counts once its marker of success is there, so what was scanned and what was
found appear together or not at all. Earlier scans are never rewritten; two scans at once may both
look at a blob, whose findings then count once.

A rule's matches are leftmost and don't overlap; matches that fail the rule's length are dropped but
have used up their text. Positions are code points, ends exclusive. The text between matches and the
matches themselves alternate, so running sums of their lengths give the positions.

Null texts count as empty and have no findings. Repeated rows get the same findings; two kinds may
find the same span, and both are listed, in the order of the rules. Texts of any length are scanned
whole, one in one task. Extra columns are kept by ``scan_paths``; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import SUCCESS, Scratch, shared_dir, under


@dataclass(frozen=True)
class Rule:
    """A pattern, the group whose length counts (0: the whole match) and the least length."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def _either(words: str) -> str:
    """Letters of ``words`` in either case, spelled out so that only A-Z fold."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


BASE_RULES = (
    Rule("assign", 1, "(" + _either("password|passwd|secret|token|api_?key") + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, "[0-9a-f]+", 0, 16),
)
MORE_RULES = (
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("hub_token", 1, "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
RULES = (*BASE_RULES, *MORE_RULES)
SPAN = "struct<start: bigint, rule: int, kind: string, end: bigint>"
#: A row of the ledger: scanned holds kind@version.
ENTRY = "blob string, scanned array<string>, spans array<struct<start: bigint, end: bigint, kind: string, version: int>>"


def blob_of(text: str):
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


class Ledger:
    """The scans in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def load(self) -> DataFrame | None:
        """Rows of all finished scans, or None before the first."""
        scans = [p for p in under(self.spark, f"{self.path}/scan-*/{SUCCESS}")]
        return self.spark.read.schema(ENTRY).parquet(*(p.removesuffix(f"/{SUCCESS}") for p in scans)) if scans else None

    def commit(self, scan: DataFrame) -> None:
        scan.write.option("compression", "zstd").parquet(f"{self.path}/scan-{uuid.uuid4().hex}")


def _rule_of(rules: tuple[Rule, ...], kind, version):
    """Place of a (kind, version) among the rules, from 1; 0 if it isn't one of them."""
    return F.array_position(F.array(*(F.lit(r.key) for r in rules)), F.concat_ws("@", kind, version.cast("string"))).cast("int")


def scan_blobs(blobs: DataFrame, seen: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of the ledger for ``blobs`` (blob, text, unique) that hold a pair which ``seen``, rows of the ledger, lacks."""
    keys = [r.key for r in rules]
    if seen is not None:
        had = seen.groupBy(F.col("blob").alias("b2")).agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("had"))
        blobs = blobs.join(had, blobs.blob == had.b2, "left").select("blob", "text", F.array_except(F.array(*map(F.lit, keys)), F.coalesce("had", F.array().cast("array<string>"))).alias("scanned"))
        blobs = blobs.where(F.size("scanned") > 0)
    else:
        blobs = blobs.select("blob", "text", F.array(*map(F.lit, keys)).alias("scanned"))
    # a run too short can't be followed by a match within itself, so least may go into these patterns
    narrow = {"hex": "[0-9a-f]{16,}", "access": "AKIA[A-Z0-9]{14,}"}
    pattern = lambda r: narrow.get(r.kind, r.pattern) if r in BASE_RULES else r.pattern
    hits = blobs.select("blob", "text", "scanned", *(F.when(F.array_contains("scanned", r.key), F.regexp_extract_all("text", F.lit(pattern(r)), F.lit(0))).alias(f"h{i}") for i, r in enumerate(rules)))
    per_rule = hits.select(
        "blob",
        "scanned",
        F.explode_outer(
            F.filter(
                F.array(*(F.when(F.size(f"h{i}") > 0, F.struct(F.lit(i).alias("rule"), F.col(f"h{i}").alias("hits"), F.transform(F.split("text", pattern(r), -1), F.length).alias("gaps"))) for i, r in enumerate(rules))),
                lambda x: x.isNotNull(),
            )
        ).alias("r"),
    )
    each = per_rule.select("blob", "scanned", "r.rule", F.posexplode_outer(F.arrays_zip(F.col("r.hits").alias("hit"), F.col("r.gaps").alias("gap")))).where("rule is null or col.hit is not null")
    each = each.select("blob", "scanned", "rule", "pos", F.col("col.hit").alias("hit"), F.length("col.hit").cast("bigint").alias("n"), F.col("col.gap").cast("bigint").alias("gap"))
    sofar = Window.partitionBy("blob", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("n")).over(sofar)
    counted = F.lit(None).cast("int")
    for i, r in enumerate(rules):
        counted = F.when(F.col("rule") == i, F.length(F.regexp_extract("hit", r.pattern, r.group)) if r.group else F.col("n")).otherwise(counted)
    of_rule = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("rule") + 1)
    ok = counted >= of_rule([r.least for r in rules])
    span = F.struct((end - F.col("n")).alias("start"), end.alias("end"), of_rule([r.kind for r in rules]).alias("kind"), of_rule([r.version for r in rules]).alias("version"))
    found = each.select("blob", "scanned", F.when(ok, span).alias("span"))
    return found.groupBy("blob").agg(F.first("scanned").alias("scanned"), F.sort_array(F.collect_list("span")).alias("spans"))


def unique_blobs(versions: DataFrame, text: str = "text") -> DataFrame:
    """(blob, text), one row per distinct text that isn't null or empty."""
    return versions.where(F.length(text) > 0).select(blob_of(text).alias("blob"), F.col(text).alias("text")).dropDuplicates(["blob"])


def scan_paths(versions: DataFrame, text: str = "text", ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with ``spans`` (array, empty where nothing is found); a column of that name is replaced.

    What ``ledger`` lacks is scanned and committed to it; without one, a new ledger is made in the shared folder.
    """
    spark = versions.sparkSession
    ledger = ledger or Ledger(spark, f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}")
    ledger.commit(scan_blobs(unique_blobs(versions, text), ledger.load(), rules))
    current = lambda s: _rule_of(rules, s["kind"], s["version"])
    spans = F.filter(F.array_distinct(F.flatten(F.collect_list("spans"))), lambda s: current(s) > 0)
    found = ledger.load().where(F.size("spans") > 0).groupBy(F.col("blob").alias("__blob2")).agg(spans.alias("s"))
    spans = F.array_sort(F.transform("s", lambda s: F.struct(s["start"].alias("start"), (current(s) - 1).alias("rule"), s["kind"].alias("kind"), s["end"].alias("end"))))
    # written, so that the join below stands on two plain shuffles and Spark can split a blob of very many paths
    found = Scratch(spark, "secrets").keep(found.select("__blob2", spans.alias("__spans")))
    paths = versions.drop("spans").withColumn("__blob", blob_of(text))
    joined = paths.join(found, F.col("__blob") == F.col("__blob2"), "left")
    return joined.select(*(c for c in versions.columns if c != "spans"), F.coalesce("__spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def digests(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns per path."""
    is_base = lambda s: s["rule"] < len(BASE_RULES)
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("spans", lambda s: s["rule"] == i)).cast("bigint")
    return scanned.select(
        key,
        *(count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)),
        F.sha2(joined(F.filter("spans", is_base)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact(scanned: DataFrame, text: str = "text") -> DataFrame:
    """``scanned`` without ``spans``, every found span in ``text`` replaced by ``[secret]``; overlapping ones by one.

    Texts without findings, null ones included, stay as they are.
    """
    spans = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"))))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        keep = F.when(s["a"] > acc["at"], F.array(F.col(text).substr((acc["at"] + 1).cast("int"), (s["a"] - acc["at"]).cast("int")), F.lit("[secret]")))
        first = (s["a"] == 0) & (acc["at"] == 0)
        more = F.when(first, F.array(F.lit("[secret]"))).otherwise(F.coalesce(keep, F.when(s["a"] == acc["at"], F.array(F.lit("[secret]"))).otherwise(F.array().cast("array<string>"))))
        return F.struct(F.greatest(acc["at"], s["b"]).alias("at"), F.concat(acc["out"], more).alias("out"))

    def finish(acc):
        return F.concat(F.array_join(acc["out"], ""), F.col(text).substr((acc["at"] + 1).cast("int"), F.length(text)))

    cleaned = F.aggregate(spans, start, step, finish)
    return scanned.withColumn(text, F.when(F.size("spans") > 0, cleaned).otherwise(F.col(text))).drop("spans")


def _oracle() -> str:
    parts = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        counted = f"length(regexp_extract(hits[i], '{p}', {r.group}))" if r.group else "length(hits[i])"
        parts.append(
            f"SELECT doc_id, {i} AS rule, '{r.kind}' AS kind, i, {counted} >= {r.least} AS ok, "
            "CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0) AS BIGINT) AS s, length(hits[i]) AS n "
            f"FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS hits, string_split_regex(text, '{p}') AS gaps FROM documents WHERE text IS NOT NULL))"
        )
    base = f"FILTER (WHERE rule < {len(BASE_RULES)})"
    return (
        "WITH f AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE ok), g AS (SELECT doc_id, "
        + ", ".join(f"count(*) FILTER (WHERE rule = {i}) AS n_{r.kind}" for i, r in enumerate(BASE_RULES))
        + f", sha256(coalesce(string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rule) {base}, '')) AS base_sha256"
        ", string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rule) AS spans FROM f GROUP BY doc_id) "
        "SELECT d.doc_id, " + ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES) + ", coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id"
    )


ORACLE = _oracle()
