"""Mixing sources to target weights by temperature, in DataFrame operations only.

Source token shares p are raised to an exponent a in [0, 1] and normalised: a = 1 keeps the corpus as
it is, a = 0 gives every source the same weight. a is bisected: the largest that reaches an entropy
target, or the smallest whose repetition stays in its limit; where both are given the limit wins.
Weights become token budgets, by default the smallest that keep every source whole, in which
source i is read (n_max / n_i) ** (1 - a) times.

Budgets are realised as permutations of blocks. A document's block is a hash of its key; each epoch
reads the blocks of a source in an order of its own. The last, partial epoch reads whole blocks up to
the one that would exceed the budget, and of that one the documents of smallest hash while they fit.
Which copies of a document are read thus depends on a few numbers per source, so no text is
shuffled: block sums are aggregated, and the plan, a row per source, is written to the shared
folder and joined; Spark broadcasts it where its size allows.

Tokens are words ``[^\\x20\\x09-\\x0D]+``. A null source is a source of its own. Sources without tokens, and
documents of null or empty text in others, are read like the rest: documents without tokens once per
full epoch, such sources once. Rows that repeat a key get the same copies; equal hashes are in or
out together. Texts of any length are counted whole, and none is shuffled. Extra columns are kept;
columns named like the added ones are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Times that a source may be read, at most.
MAX_REPEAT = 2.0
STEPS = 40
SEED = "mix"
ADDED = ("n_tokens", "epoch", "block", "block_order")


def tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _md5(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p for p in parts)).cast("binary"))


def plan(stats: DataFrame, max_repeat: float | None = MAX_REPEAT, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """Per source of ``stats`` (sk, n): weight, exponent, epochs (whole ones) and rest (tokens of the partial one).

    All shares stand in one array in one row, so it takes one task; a row of ``stats`` is a source.
    """
    one = stats.agg(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("sk", F.col("n").cast("double").alias("n"))))).alias("s"))
    one = one.select("s", F.aggregate("s", F.lit(0.0), lambda a, x: a + x["n"]).alias("total"), F.aggregate("s", F.lit(0.0), lambda a, x: F.greatest(a, x["n"])).alias("most"))
    raised = lambda x, a: F.pow(x["n"] / F.col("most"), a)

    def repeats(a: Column) -> Column:
        """The most often that any source is read."""
        if budget is None:
            return F.aggregate("s", F.lit(0.0), lambda m, x: F.greatest(m, raised(x, a) * F.col("most") / x["n"]))
        z = F.aggregate("s", F.lit(0.0), lambda m, x: m + raised(x, a))
        return F.aggregate("s", F.lit(0.0), lambda m, x: F.greatest(m, raised(x, a) * F.lit(float(budget)) / z / x["n"]))

    def spread(a: Column) -> Column:
        """Entropy of the weights, in nats."""
        z = F.aggregate("s", F.lit(0.0), lambda m, x: m + raised(x, a))
        return F.aggregate("s", F.lit(0.0), lambda m, x: m - raised(x, a) / z * F.log(raised(x, a) / z))

    def bisect(high_is_good) -> Column:
        """The least a for which high_is_good(a) holds from a on, to 2 ** -STEPS; 0 or 1 at the ends."""
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(STEPS)),
            F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")),
            lambda acc, _: F.when(high_is_good((acc["lo"] + acc["hi"]) / 2), F.struct(acc["lo"].alias("lo"), ((acc["lo"] + acc["hi"]) / 2).alias("hi"))).otherwise(F.struct(((acc["lo"] + acc["hi"]) / 2).alias("lo"), acc["hi"].alias("hi"))),
            lambda acc: acc["hi"],
        )

    floor = bisect(lambda a: repeats(a) <= F.lit(float(max_repeat))) if max_repeat is not None else F.lit(0.0)
    wanted = bisect(lambda a: spread(a) < F.lit(float(entropy))) if entropy is not None else floor
    one = one.withColumn("exponent", F.least(F.lit(1.0), F.ceil(F.greatest(floor, wanted) * 1e6) / 1e6))
    z = F.aggregate("s", F.lit(0.0), lambda m, x: m + raised(x, F.col("exponent")))
    rows = one.withColumn("z", z).select("exponent", "most", "z", F.explode("s").alias("x")).select("exponent", "z", F.col("x.sk").alias("sk"), F.col("x.n").alias("n"), raised(F.col("x"), F.col("exponent")).alias("w"), "most")
    times = F.col("w") * F.col("most") / F.col("n") if budget is None else F.col("w") / F.col("z") * float(budget) / F.col("n")
    rows = rows.select("sk", "exponent", (F.col("w") / F.col("z")).alias("weight"), "n", F.round(times, 9).alias("times"))
    rows = rows.select("sk", "exponent", "weight", F.floor("times").cast("bigint").alias("epochs"), F.floor((F.col("times") - F.floor("times")) * F.col("n")).cast("bigint").alias("rest"))
    none = stats.where("n = 0").select("sk", F.lit(None).cast("double").alias("exponent"), F.lit(0.0).alias("weight"), F.lit(1).cast("bigint").alias("epochs"), F.lit(0).cast("bigint").alias("rest"))
    return rows.unionByName(none)


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", max_repeat: float | None = MAX_REPEAT, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """Every copy that the mix reads: the columns of ``docs`` with n_tokens, epoch (from 0), block and block_order.

    Reading order is epoch, then block_order.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    own = [c for c in docs.columns if c not in ADDED]
    sk = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    of = F.coalesce(F.col(key).cast("string"), F.lit(""))
    marked = docs.select(*own, sk.alias("__sk"), tokens(text).alias("n_tokens"), _md5(SEED, of).alias("__h"))
    marked = marked.withColumn("block", F.substring("__h", 1, 3))
    order = lambda epoch: F.substring(_md5(SEED, F.col("__sk"), epoch.cast("string"), F.col("block")), 1, 15)
    light = scratch.cut(marked.groupBy("__sk", "block", "__h").agg(F.sum("n_tokens").alias("n")))
    blocks = scratch.cut(light.groupBy("__sk", "block").agg(F.sum("n").alias("n")))
    plans = scratch.cut(plan(blocks.groupBy(F.col("__sk").alias("sk")).agg(F.sum("n").alias("n")), max_repeat, entropy, budget))
    # blocks of the partial epoch in their order; the first that doesn't fit is cut
    ranked = blocks.join(plans, F.col("__sk") == F.col("sk")).where("rest > 0").withColumn("block_order", order(F.col("epochs")))
    sofar = Window.partitionBy("sk").orderBy("block_order").rangeBetween(Window.unboundedPreceding, 0)
    cut = ranked.withColumn("upto", F.sum("n").over(sofar)).where("upto > rest").groupBy("sk").agg(F.min_by(F.struct("block_order", "block", (F.col("rest") - (F.col("upto") - F.col("n"))).alias("left")), "block_order").alias("c")).select("sk", "c.*")
    inside = light.join(cut.select(F.col("sk"), F.col("block").alias("b2"), "left"), (F.col("__sk") == F.col("sk")) & (F.col("block") == F.col("b2")))
    fits = inside.withColumn("upto", F.sum("n").over(Window.partitionBy("sk").orderBy("__h").rangeBetween(Window.unboundedPreceding, 0))).where("upto <= left").groupBy("sk").agg(F.max("__h").alias("last_h"))
    limits = scratch.cut(
        plans.join(cut.select(F.col("sk").alias("s2"), F.col("block_order").alias("cut_order")), F.col("sk") == F.col("s2"), "left")
        .join(fits.select(F.col("sk").alias("s3"), "last_h"), F.col("sk") == F.col("s3"), "left")
        .select("sk", "epochs", "rest", "cut_order", "last_h")
    )
    limits = limits.select(*(F.col(c).alias(f"__{c}") for c in limits.columns)).withColumnRenamed("__sk", "__of")
    joined = marked.join(limits, F.col("__sk") == F.col("__of"), "left")
    last = order(F.col("__epochs"))
    extra = (F.col("__rest") > 0) & (F.col("__cut_order").isNull() | (last < F.col("__cut_order")) | ((last == F.col("__cut_order")) & F.coalesce(F.col("__h") <= F.col("__last_h"), F.lit(False))))
    times = F.col("__epochs") + F.when(extra, 1).otherwise(0)
    copies = joined.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("bigint"), times - 1))))
    return copies.select(*own, "n_tokens", "epoch", F.conv("block", 16, 10).cast("int").alias("block"), order(F.col("epoch")).alias("block_order"))


ORACLE = f"""
WITH RECURSIVE m AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS sk, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), s AS (SELECT sk, CAST(sum(n_tokens) AS DOUBLE) AS n FROM m GROUP BY sk), mx AS (SELECT max(n) AS most FROM s),
bis(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL SELECT i + 1, CASE WHEN good THEN lo ELSE (lo + hi) / 2 END, CASE WHEN good THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT i, lo, hi, (SELECT coalesce(max(pow(n / most, (lo + hi) / 2) * most / n), 0) FROM s, mx WHERE n > 0) <= {MAX_REPEAT} AS good FROM bis WHERE i < {STEPS})
), ex AS (SELECT least(1, ceil(hi * 1e6) / 1e6) AS a FROM bis WHERE i = {STEPS}),
p0 AS (SELECT sk, n, round(pow(n / most, a) * most / n, 9) AS times FROM s, mx, ex WHERE n > 0),
p AS (SELECT sk, CAST(floor(times) AS BIGINT) AS epochs, CAST(floor((times - floor(times)) * n) AS BIGINT) AS rest FROM p0 UNION ALL SELECT sk, 1, 0 FROM s WHERE n = 0),
d AS (SELECT m.*, p.epochs, p.rest, substr(h, 1, 3) AS block, substr(md5('{SEED}:' || m.sk || ':' || epochs || ':' || substr(h, 1, 3)), 1, 15) AS last_order FROM m JOIN p ON m.sk = p.sk),
b AS (SELECT sk, last_order, rest, sum(n_tokens) AS n FROM d WHERE rest > 0 GROUP BY ALL),
bc AS (SELECT *, sum(n) OVER (PARTITION BY sk ORDER BY last_order) AS upto FROM b),
c AS (SELECT sk, min(last_order) AS cut_order, min_by(rest - (upto - n), last_order) AS remaining FROM bc WHERE upto > rest GROUP BY sk),
f0 AS (SELECT d.sk, h, remaining, sum(n_tokens) OVER (PARTITION BY d.sk ORDER BY h) AS upto FROM d JOIN c ON d.sk = c.sk AND d.last_order = c.cut_order),
f AS (SELECT sk, max(h) AS last_h FROM f0 WHERE upto <= remaining GROUP BY sk),
k AS (SELECT d.*, epochs + CASE WHEN rest > 0 AND (cut_order IS NULL OR last_order < cut_order OR (last_order = cut_order AND coalesce(h <= last_h, false))) THEN 1 ELSE 0 END AS times
  FROM d LEFT JOIN c ON d.sk = c.sk LEFT JOIN f ON d.sk = f.sk),
x AS (SELECT *, unnest(range(0, times)) AS epoch FROM k)
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, epoch, CAST(('0x' || block) AS INTEGER) AS block,
  substr(md5('{SEED}:' || sk || ':' || epoch || ':' || block), 1, 15) AS block_order FROM x
"""
