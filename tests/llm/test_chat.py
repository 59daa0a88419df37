import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataprobe.llm import chat

CONV = "conv_id long, turn long, role string, text string, node long, score double"
NASTY = ["", "\\", "</turn>", "<\\/turn>", "###", "#### a", "\\### Assistant: </turn> ok", "a\n### user: b</turn>\n", "\\\\</turn>\\", "é漢😀 # ##", "x" * 20000]


def formatted(spark, rows):
    nodes = chat.turn_chain(spark.createDataFrame([(*r, None, None) for r in rows], CONV))
    out = chat.format_paths(chat.reply_paths(nodes), nodes)
    return {r["tree"]: r for r in out.select("*", chat.parse_formatted(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}


def test_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, "sys:tem %3A<#\n", None), (2, 1, None, "hi"), (3, 5, "assistant", "only"), (None, 0, "user", "lost"), (4, 0, "user", "same"), (4, 0, "user", "same"), (4, None, "user", "first")]
    got = formatted(spark, rows)
    assert set(got) == {1, 2, 3, 4}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)]
    assert got[1]["loss"] == "".join(NASTY[1::2])
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("sys:tem %3A<#\n", ""), ("", "hi")] and got[2]["loss"] == ""
    assert [t["text"] for t in got[4]["turns"]] == ["first", "same", "same"]
    for r in got.values():
        assert r["formatted"].count("</turn>\n") == len(r["turns"]) == r["formatted"].count("### ")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="\\#</turn>: \nx", max_size=30))
def test_escape_rules(t):
    """The escape as the column functions do it, in plain Python."""
    import re

    e = re.sub(r"(?<=#)#", r"\\#", t.replace("\\", "\\\\").replace("</turn>", "<\\/turn>"))
    assert "</turn>" not in e and "###" not in e and "##" not in e
    assert re.sub(r"(?s)\\(.)", r"\1", e) == t


def paths(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["tree"], r["branch_rank"]), {})[r["step"]] = r["node"]
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


def test_branches_are_ranked_and_enumerated(spark):
    nodes = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 5.0), ("t", 4, 2, 9.0), ("t", 5, 3, None), ("u", 1, 99, 1.0), ("c", 1, 2, 0.0), ("c", 2, 1, 0.0), ("d", 7, None, 1.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    assert paths(chat.reply_paths(df, top=1)) == {("t", 1): [1, 2, 4], ("u", 1): [1], ("d", 1): [7]}
    assert paths(chat.reply_paths(df, top=None)) == {("t", 1): [1, 2, 4], ("t", 2): [1, 3, 5], ("u", 1): [1], ("d", 1): [7]}


def test_repeated_and_missing_ids(spark):
    rows = [("t", 1, None, 0.0, "user", "q"), ("t", 1, None, 0.0, "user", "q"), ("t", 2, 9, 7.0, "user", "z"), ("t", 2, 1, 4.0, "assistant", "b"), ("t", 2, 1, 3.0, "assistant", "a"), ("t", None, 1, 9.0, "user", "x"), (None, 3, None, 1.0, "user", "y")]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string").withColumn("step", F.lit("clash"))
    found = chat.reply_paths(df, top=None)
    assert paths(found) == {("t", 1): [1, 2]} and found.count() == 2
    assert {r["branch_score"] for r in found.collect()} == {1.5}
    out = chat.format_paths(found, df).collect()
    assert [r["formatted"] for r in out] == ["### user: q</turn>\n### assistant: a</turn>\n"]


def test_long_chain_takes_few_rounds(spark):
    df = spark.range(300).selectExpr("'x' as tree", "id as node", "case when id > 0 then id - 1 end as parent", "0D as score")
    assert paths(chat.reply_paths(df)) == {("x", 1): list(range(300))}


def test_contract_query(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.op5_chat_format(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    f = chat.FENCE_CASE
    assert got[-7]["turns_sha256"] == sha(f"user\n{f}\nassistant\n{f}\n") and got[-7]["loss_sha256"] == sha(f) and got[-7]["loss_chars"] == len(f)
    assert got[1]["n_turns"] == 2 and got[1]["formatted_chars"] == len("### user: q</turn>\n### assistant: a</turn>\n")


def test_empty(spark):
    assert chat.reply_paths(spark.createDataFrame([], "tree long, node long, parent long, score double")).count() == 0
