"""Chat formatting of reply trees, in DataFrame operations only.

Nodes are (tree, node, parent, role, text, score). Iterative self-joins double the distance that
each node's ancestor link spans, so a tree of depth d takes log2(d) joins, and give every node its
depth and the score of its root-to-node path. Leaves are the branches; they are ranked in their tree
by the path's mean score, ties to the smaller leaf id. Chosen paths are spelled out by walking the
same links downwards in powers of two, and each is formatted as one conversation.

The template writes ``<|turn|>role\\ntext<|end|>\\n``. Inside roles and texts ``&``, ``<`` and ``[`` become
``&amp;``, ``&lt;`` and ``&lsq;`` (and a line feed in a role ``&nl;``), so no control string of this or of
another chat template survives in them, and ``unescape`` restores every text exactly.

A null parent, or one that isn't in the tree, makes a root. Nodes on a cycle hang on no root and
are in no conversation. Null roles and texts count as empty, null scores as 0. A null tree is a
tree of its own. Rows that repeat a (tree, node) are one node: the first by role and text.
Texts of any length are taken whole. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

TURN, END = "<|turn|>", "<|end|>\n"
#: What is escaped, in order; unescaping goes backwards.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsq;"), ("\n", "&nl;"))


def escape(text: Column, role: bool = False) -> Column:
    for plain, safe in ESCAPES if role else ESCAPES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def branches(nodes: DataFrame, scratch: Scratch, top: int | None = None) -> DataFrame:
    """(tree, leaf, branch_rank, branch_score, node, position) of the chosen root-to-leaf paths.

    ``nodes`` has unique non-null (tree, node) keys. ``top``: branches kept of each tree, None for all.
    """
    keys = scratch.cut(nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    known = keys.select(F.col("tree").alias("t2"), F.col("node").alias("up"))
    hop = keys.join(known, (F.col("tree") == F.col("t2")) & (F.col("parent") == F.col("up")), "left").select("tree", "node", "up", F.col("score").alias("total"), F.lit(1).cast("bigint").alias("depth"))
    state = scratch.cut(hop)
    # a node is done once its link has passed the root; only the others are joined again
    hops, done = [], [state.where("up is null")]
    n, span, rest = keys.count(), 1, state.where("up is not null")
    while span <= n and rest.limit(1).count():
        hops.append(rest)
        every = reduce(DataFrame.unionByName, [rest, *done])
        of_up = every.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        state = scratch.cut(rest.join(of_up, (F.col("tree") == F.col("t2")) & (F.col("up") == F.col("n2"))).select("tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"), (F.col("depth") + F.col("depth2")).alias("depth")))
        done.append(state.where("up is null"))
        rest = state.where("up is not null")
        span *= 2
    done = reduce(DataFrame.unionByName, done)
    parents = keys.select("tree", F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = done.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), (F.col("total") / F.col("depth")).alias("branch_score"), "depth")
    order = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
    leaves = leaves.withColumn("branch_rank", F.row_number().over(order))
    if top is not None:
        leaves = leaves.where(F.col("branch_rank") <= top)
    path = leaves.select("*", F.col("leaf").alias("node"), F.col("depth").alias("position"))
    for k, hop in enumerate(hops):
        up = hop.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "up")
        more = path.join(up, (F.col("tree") == F.col("t2")) & (F.col("node") == F.col("n2"))).select(*(c for c in path.columns if c not in ("node", "position")), F.col("up").alias("node"), (F.col("position") - (1 << k)).alias("position"))
        path = scratch.cut(path.unionByName(more))
    return path.drop("depth")


def format_trees(nodes: DataFrame, top: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """One row per chosen path: tree, leaf, branch_rank, branch_score, formatted, segments.

    ``segments`` cuts ``formatted`` into pieces (text, loss): concatenated they are ``formatted``, and those
    with ``loss`` are what a model is trained to say, each text of ``loss_role`` once and in order.
    """
    scratch = Scratch(nodes.sparkSession, "chat")
    first = Window.partitionBy("tree", "node").orderBy("parent", "role", "text", "score")
    nodes = nodes.select(_key("tree").alias("tree"), F.col("tree").alias("tree_id"), "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")
    nodes = scratch.cut(nodes.where("node is not null").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n"))
    paths = branches(nodes, scratch, top)
    said = nodes.select(F.col("tree").alias("t2"), F.col("node").alias("n2"), "tree_id", "role", "text")
    turns = paths.join(said, (F.col("tree") == F.col("t2")) & (F.col("node") == F.col("n2")))
    turn = F.struct("position", "role", "text")
    talk = turns.groupBy("tree", "leaf").agg(F.first("tree_id").alias("tree_id"), F.first("branch_rank").alias("branch_rank"), F.first("branch_score").alias("branch_score"), F.array_sort(F.collect_list(turn)).alias("turns"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                piece(F.concat(F.lit(TURN), escape(t["role"], role=True), F.lit("\n")), F.lit(False)),
                piece(escape(t["text"]), t["role"] == loss_role),
                piece(F.lit(END), F.lit(False)),
            ),
        )
    )
    out = talk.select(F.col("tree_id").alias("tree"), "leaf", "branch_rank", "branch_score", segments.alias("segments"))
    return out.select("tree", "leaf", "branch_rank", "branch_score", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def _key(name: str) -> Column:
    """A non-null join key of a column."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def read_back(formatted: str = "formatted", segments: str = "segments") -> tuple[Column, Column]:
    """Turns (role, text) parsed from the formatted text, and the unescaped text under the loss mask."""
    parts = F.slice(F.split(F.col(formatted), r"<\|turn\|>", -1), F.lit(2), F.greatest(F.size(F.split(F.col(formatted), r"<\|turn\|>", -1)) - 1, F.lit(0)))
    role = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: p.substr(F.length(role(p)) + 2, F.length(p) - F.length(role(p)) - 1 - len(END))
    turns = F.transform(parts, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(body(p)).alias("text")))
    loss = F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return turns, loss


def linear(conversations: DataFrame) -> DataFrame:
    """Conversations as trees without branches: the turns of a conv_id in order, each replying to the one before.

    Turns are ordered by turn, then role, then text, nulls first; nodes are numbered in that order.
    """
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = rows.withColumn("node", F.row_number().over(order).cast("bigint"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns of a formatted table, read back from its output."""
    turns, loss = read_back()
    read = formatted.select(F.col("tree").alias("conv_id"), turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT CAST(-1 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsq;') AS safe_text,
    replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsq;'), chr(10), '&nl;') AS safe_role FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(safe_role) + 1 + length(safe_text) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
