"""Chat formatting over reply trees.

Turns form trees by parent links. Self-joins by pointer doubling give every node its root, its depth
and the sum of scores above it; leaves are ranked by mean branch score within their tree; the chosen
leaves' paths are enumerated by the same doubled links, and each path becomes one formatted string.

Template of a turn:  ``### <role>: <text></turn>\\n``
Inside texts ``\\`` is doubled, ``</turn>`` becomes ``<\\/turn>`` and every ``#`` after a ``#`` gets a
backslash, so neither control string occurs in an escaped text and ``\\X -> X`` restores it. Roles are
percent-encoded where they hold a character of the template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

TURN_END = "</turn>\n"
HEAD = "### "
ROLE_CODES = [("%", "%25"), (":", "%3A"), ("<", "%3C"), ("#", "%23"), ("\n", "%0A")]


def escape_text(text: Column) -> Column:
    t = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    t = F.replace(t, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.regexp_replace(t, "(?<=#)#", r"\\#")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def encode_role(role: Column) -> Column:
    for raw, code in ROLE_CODES:
        role = F.replace(role, F.lit(raw), F.lit(code))
    return role


def decode_role(role: Column) -> Column:
    for raw, code in reversed(ROLE_CODES):
        role = F.replace(role, F.lit(code), F.lit(raw))
    return role


def reply_paths(nodes: DataFrame, top: int | None = 1, max_rounds: int = 40) -> DataFrame:
    """nodes(tree, node, parent, score) -> (tree, path, leaf, branch_rank, branch_score, step, node):
    the `top` best root-to-leaf paths of each tree (all: None), nodes numbered from 0 at the root.

    A branch's score is the mean of its nodes' scores (null: 0); ties go to the smaller leaf. A parent
    that is null or no node of the tree makes its child a root. Rows that repeat an id in a tree count once, with the
    least parent (null before others) and its least score; rows without a tree or an id are left out. Nodes
    on a cycle reach no root and are left out. Joins double the link length each round, so a chain
    of n turns takes log2(n) rounds.
    """
    one = F.min(F.struct("parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("one")
    base = nodes.where("tree is not null and node is not null").groupBy("tree", "node").agg(one)
    base = base.select("tree", "node", "one.parent", "one.score")
    known = base.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    links = base.join(known, ["tree", "parent"], "left").select(
        "tree",
        "node",
        F.when(F.col("known"), F.col("parent")).alias("up"),
        F.lit(1).alias("hops"),
        F.col("score").alias("total"),
    )
    steps = [written(links, "links")]
    open_before = -1
    for _ in range(max_rounds):
        cur = steps[-1]
        still_open = cur.where("up is not null").count()
        if still_open in (0, open_before):  # each round settles a node unless only cycles are left
            break
        open_before = still_open
        far = cur.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("h2"), F.col("total").alias("t2"))
        nxt = cur.where("up is not null").join(far, ["tree", "up"], "left").select(
            "tree",
            "node",
            F.col("up2").alias("up"),
            (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"),
            (F.col("total") + F.coalesce("t2", F.lit(0.0))).alias("total"),
        )
        steps.append(written(cur.where("up is null").unionByName(nxt), "links"))  # settled nodes don't join again
    done = steps[-1].where("up is null")
    parents = steps[0].where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = done.join(parents, ["tree", "node"], "left_anti")
    rank = Window.partitionBy("tree").orderBy(F.col("branch_score").desc(), F.col("node"))
    leaves = leaves.withColumn("branch_score", F.col("total") / F.col("hops")).withColumn("branch_rank", F.row_number().over(rank))
    if top is not None:
        leaves = leaves.where(F.col("branch_rank") <= top)
    leaves = leaves.select("tree", F.col("node").alias("leaf"), "branch_rank", "branch_score", "hops")
    on = leaves.select("*", F.col("leaf").alias("node"), F.lit(0).alias("height"))
    for k in range(len(steps) - 1):
        jump = steps[k].where("up is not null").select("tree", "node", "up")
        on = on.unionByName(
            on.join(jump, ["tree", "node"]).select(
                "tree", "leaf", "branch_rank", "branch_score", "hops", F.col("up").alias("node"), (F.col("height") + 2**k).alias("height")
            )
        )
        on = written(on, "paths") if k % 3 == 2 else on
    return on.select("tree", "leaf", "branch_rank", "branch_score", (F.col("hops") - 1 - F.col("height")).cast("int").alias("step"), "node")


def format_paths(paths: DataFrame, turns: DataFrame) -> DataFrame:
    """paths as from reply_paths, turns(tree, node, role, text) -> one row a path: tree, leaf,
    branch_rank, branch_score, formatted, loss_spans (0-based start and end, in code points, of the
    escaped text of each assistant turn). A null role or text counts as empty; of turns that repeat an id in a
    tree the least by role and text is taken. An empty table gives no rows; other columns are ignored."""
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(HEAD), encode_role(role), F.lit(": "))
    body = escape_text(F.coalesce(F.col("text"), F.lit("")))
    rows = paths.join(turns.select("tree", "node", "role", "text"), ["tree", "node"]).select(
        "tree", "leaf", "branch_rank", "branch_score", F.struct("step", head.alias("head"), body.alias("body"), (role == "assistant").alias("loss")).alias("t")
    )
    whole = rows.groupBy("tree", "leaf", "branch_rank", "branch_score").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    first = lambda t, i: (i == 0) | (t["step"] != F.get("ts", i - 1)["step"])
    whole = whole.withColumn("ts", F.filter("ts", first))
    pieces = F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(TURN_END)))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(acc, t):
        begin = acc["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(TURN_END)).alias("at"), F.when(t["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("ts", F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")), add, lambda acc: acc["spans"])
    return whole.select("tree", "leaf", "branch_rank", "branch_score", F.concat_ws("", pieces).alias("formatted"), spans.alias("loss_spans"))


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted string: array<struct<role, text>>, escapes undone."""
    parts = F.split(formatted, TURN_END)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(p):
        at = F.locate(": ", p)
        return F.struct(
            decode_role(F.substring(p, F.lit(len(HEAD) + 1), at - (len(HEAD) + 1))).alias("role"),
            unescape_text(F.substring(p, at + 2, F.length(p))).alias("text"),
        )

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape_text(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))))


def turn_chain(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as reply nodes: each turn answers the one before it. Rows of
    one turn follow each other by role and text; a null turn comes first, a null conv_id is left out."""
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    n = F.row_number().over(order)
    return (
        conversations.where("conv_id is not null")
        .select(F.col("conv_id").alias("tree"), "turn", "role", "text")
        .select("tree", n.alias("node"), F.when(n > 1, n - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
    )


FENCE_CASE = "\\### Assistant: </turn> ok"


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, read back from its format."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fence = spark.createDataFrame([(-7, 0, "user", FENCE_CASE), (-7, 1, "assistant", FENCE_CASE)], conv.schema)
    nodes = written(turn_chain(conv.unionByName(fence)), "turns")
    out = format_paths(reply_paths(nodes), nodes)
    turns = F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        out.withColumn("turns", parse_formatted(F.col("formatted")))
        .withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
        .select(
            F.col("tree").alias("conv_id"),
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.concat_ws("", turns), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2("loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (
  SELECT *, replace(replace(replace(replace(replace(role, '%', '%25'), ':', '%3A'), '<', '%3C'), '#', '%23'), chr(10), '%0A') AS enc,
    -- a '#' that follows another gets a backslash: one less than the length of each run of '#'
    length(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'))
      + coalesce(list_sum([length(r) - 1 FOR r IN regexp_extract_all(text, '#+')]), 0) AS esc_len
  FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(enc) + 2 + esc_len + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
