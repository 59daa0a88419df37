"""Line dedup by a log-template tree, in DataFrame functions throughout.

A line falls through a tree of fixed depth: by its number of words, then by its leading words, where
words with a digit are one wildcard. In a leaf, the positions whose words vary become wildcards as well;
lines near enough to the leaf's template take it, others are templates of their own. A leaf may hold several
families of lines, so that each set of words frequent at their positions is a template beside it. Lines with a
template that recurs in enough documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
WILD = "<*>"
#: Leaves up to which their list is broadcast (8 bytes each); beyond it the join shuffles.
BROADCAST_LEAVES = 1_000_000
#: Parts over which the lines that share a frequent word are dealt.
WORD_SALTS = 16


def masked_words(line: Column) -> Column:
    """The words of a trimmed line; only in lines with a digit are words looked at one by one."""
    words = F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, SPACE))
    masked = F.transform(words, lambda w: F.when(F.regexp_like(w, F.lit("[0-9]")), F.lit(WILD)).otherwise(w))
    return F.when(F.regexp_like(line, F.lit("[0-9]")), masked).otherwise(words)


def _lines(docs: DataFrame, id_col: str, text_col: str, depth: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.xxhash64(text).alias("th"), F.octet_length(text).alias("size"), text.alias("text"))
    rows = rows.select("doc_id", "rid", "th", "size", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(BLANKS)))
    rows = rows.select("doc_id", "rid", "th", "size", "pos", masked_words(F.col("line")).alias("words"))
    n = F.size("words")
    return rows.select(
        "doc_id", "rid", "th", "size", "pos", "words", n.alias("n"), F.xxhash64(n, F.slice("words", 1, depth)).alias("leaf"), F.xxhash64(n, "words").alias("sig")
    )


def drop_recurring_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 5,
    depth: int = 3,
    similar: float = 0.7,
    constant: float = 0.5,
) -> DataFrame:
    """doc_id, text, n_lines, n_dropped for every row of docs; text without its dropped lines.

    Lines are cut at \\n. A line without words is never dropped. Words are runs of other characters than ASCII white space. A position of a leaf is constant
    if one word has at least `constant` of the leaf's documents there; a line takes the leaf's template if at least
    `similar` of its words are the template's constants. Besides, at every threshold of min_docs times a power of two,
    the words that as many of the leaf's documents have at a position are a line's constants there, and lines of equal
    constants share a template, if these are at least `similar` of the line's words without a digit. A template recurs if lines of at least
    min_docs rows of docs have it. A null text counts as empty, one line. Repeated rows count as
    documents of their own. An empty table gives no rows; other columns are ignored.

    Lines are counted by hashes of 8 bytes; words are spread only for leaves where lines differ.
    """
    lines = _lines(docs, id_col, text_col, depth)
    slim = written(lines.select("doc_id", "rid", "th", "size", "pos", "n", "leaf", "sig"), "lines")
    counted = slim.where("n > 0").select("leaf", "sig", "rid").distinct().groupBy("leaf", "sig").agg(F.count("*").alias("docs"))
    counted = written(counted, "sigs")
    leaves = counted.groupBy("leaf").agg(F.count("*").alias("sigs"), F.sum("docs").alias("docs")).where((F.col("sigs") > 1) & (F.col("docs") >= min_docs)).select("leaf")
    leaves = written(leaves, "leaves")
    small = leaves.count() <= BROADCAST_LEAVES
    varied = lines.select("leaf", "sig", "words").join(F.broadcast(leaves) if small else leaves, "leaf")
    varied = written(varied.groupBy("leaf", "sig").agg(F.first("words").alias("words")).join(counted, ["leaf", "sig"]), "varied")
    spread = varied.select("leaf", "docs", F.posexplode("words").alias("at", "word"))
    spread = spread.groupBy("leaf", "at", "word").agg(F.sum("docs").alias("docs"))
    top = spread.groupBy("leaf", "at").agg(F.sum("docs").alias("all"), F.max(F.struct("docs", "word")).alias("top"))
    word = F.when((F.col("top.docs") >= constant * F.col("all")) & (F.col("top.word") != WILD), F.col("top.word"))
    made = top.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("at", word.alias("word")))).alias("template"))
    same = F.size(F.filter(F.zip_with("words", "template", lambda w, t: w == t["word"]), lambda x: F.coalesce(x, F.lit(False))))
    takes = varied.join(made, "leaf").where(same >= similar * F.size("words")).select("leaf", "sig", F.lit(True).alias("general"))
    placed = counted.join(takes, ["leaf", "sig"], "left")
    key = F.when(F.col("general"), F.lit(0)).otherwise(F.col("sig"))
    placed = written(placed.select("leaf", "sig", "docs", "general", key.alias("key")), "placed")
    alone = placed.where("general is null").where(F.col("docs") >= min_docs).select("leaf", "sig")
    # documents of a general template: a document may hold several of its lines
    general = placed.where("general").select("leaf", "sig")
    within = slim.select("leaf", "sig", "rid").join(general, ["leaf", "sig"]).select("leaf", "rid").distinct().groupBy("leaf").count()
    often = general.join(within.where(F.col("count") >= min_docs).select("leaf"), "leaf").select("leaf", "sig")
    gone = written(alone.unionByName(often), "gone")
    gone = gone.unionByName(_families(varied, gone, slim, min_docs, similar)).distinct().withColumn("gone", F.lit(True))
    gone = written(gone, "gone")
    marked = slim.where("n > 0").join(gone, ["leaf", "sig"]).select("rid", "pos").groupBy("rid").agg(F.count("*").alias("n_dropped"))
    per_row = slim.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n_lines"), F.first("th").alias("th"), F.first("size").alias("size"))
    facts = written(per_row.join(marked, "rid", "left"), "facts")
    # which lines of a text go: the same for equal texts, so one row a text
    some = facts.where("n_dropped > 0").groupBy("th", "size").agg(F.min("rid").alias("rid"))
    flags = (
        slim.join(some.select("rid"), "rid")
        .join(gone, ["leaf", "sig"], "left")
        .groupBy("rid")
        .agg(F.array_sort(F.collect_list(F.struct("pos", ((F.col("n") > 0) & F.coalesce("gone", F.lit(False))).alias("gone")))).alias("flags"))
    )
    per_text = some.join(flags, "rid").select(F.col("th").alias("t"), F.col("size").alias("s"), F.col("flags.gone").alias("gone"))
    per_text = written(per_text, "flags")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), F.octet_length(text).alias("size"), text.alias("text"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.get("gone", i)), "\n")
    lost = F.size(F.filter("gone", lambda g: g))
    # flags pack to next to nothing on disk, so the planner's estimate of their size must not have them broadcast
    return base.join(per_text.hint("merge"), (F.col("th") == F.col("t")) & (F.col("size") == F.col("s")), "left").select(
        "doc_id",
        F.when(F.col("gone").isNotNull(), kept).otherwise(F.col("text")).alias("text"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNotNull(), lost).otherwise(0).cast("long").alias("n_dropped"),
    )


def _families(varied: DataFrame, gone: DataFrame, slim: DataFrame, min_docs: int, similar: float) -> DataFrame:
    """(leaf, sig) of the lines that a set of frequent words makes recur, in leaves where not all lines are gone."""
    left = varied.select("leaf", "sig").join(gone, ["leaf", "sig"], "left_anti").withColumn("left", F.lit(True))
    left = written(left, "left")
    open_leaves = left.select("leaf").distinct()
    some = varied.join(open_leaves, "leaf").select("leaf", "sig", "words", "docs")
    words = some.select("leaf", "sig", "docs", F.posexplode("words").alias("at", "word")).where(F.col("word") != WILD)
    frequent = words.groupBy("leaf", "at", "word").agg(F.sum("docs").alias("all")).where(F.col("all") >= min_docs)
    level = F.floor(F.log2(F.col("all") / F.lit(float(min_docs)))).cast("int").alias("level")
    salts = F.explode(F.sequence(F.lit(0), F.lit(WORD_SALTS - 1))).alias("salt")
    held = words.withColumn("salt", F.pmod("sig", F.lit(WORD_SALTS)).cast("int")).join(frequent.select("leaf", "at", "word", level, salts), ["leaf", "at", "word", "salt"])
    held = held.groupBy("leaf", "sig").agg(F.first("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("at", "word", "level"))).alias("held"))
    held = held.join(some.select("leaf", "sig", F.size(F.filter("words", lambda w: w != WILD)).alias("plain")), ["leaf", "sig"])
    made = held.select("leaf", "sig", "docs", "plain", "held", F.explode(F.array_distinct(F.col("held.level"))).alias("least"))
    made = made.withColumn("held", F.filter("held", lambda h: h["level"] >= F.col("least"))).where(F.size("held") >= similar * F.col("plain"))
    made = made.select("leaf", "sig", "docs", F.xxhash64("leaf", "held").alias("family"))
    made = written(made.join(left, ["leaf", "sig"], "left"), "families")
    likely = made.groupBy("leaf", "family").agg(F.sum("docs").alias("docs"), F.count("*").alias("sigs"), F.max("left").alias("left"))
    likely = likely.where((F.col("docs") >= min_docs) & (F.col("sigs") > 1) & F.col("left")).select("leaf", "family")
    likely = written(made.join(likely, ["leaf", "family"]).select("leaf", "sig", "family", "left"), "likely")
    within = slim.select("leaf", "sig", "rid").join(likely, ["leaf", "sig"]).select("leaf", "family", "rid").distinct().groupBy("leaf", "family").count()
    return likely.where("left").join(within.where(F.col("count") >= min_docs), ["leaf", "family"]).select("leaf", "sig").distinct()


def op6_line_templates(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document; a template recurs from 5 documents on."""
    out = drop_recurring_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l0 AS (SELECT rid, pos, ls[pos] AS line, [CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END FOR w IN regexp_extract_all(ls[pos], '[^\x20\x09-\x0D]+')] AS words
  FROM (SELECT rid, ls, unnest(range(1, len(ls) + 1)) AS pos FROM d)),
l AS (SELECT *, len(words) AS n, array_to_string([len(words)::VARCHAR] || words[1:3], ' ') AS leaf, array_to_string(words, ' ') AS sig FROM l0),
c AS (SELECT leaf, sig, any_value(words) AS words, count(DISTINCT rid) AS docs FROM l WHERE n > 0 GROUP BY leaf, sig),
v AS (SELECT c.* FROM c JOIN (SELECT leaf FROM c GROUP BY leaf HAVING count(*) > 1 AND sum(docs) >= 5) USING (leaf)),
s AS (SELECT leaf, a, words[a] AS word, sum(docs)::BIGINT AS docs FROM (SELECT *, unnest(range(1, len(words) + 1)) AS a FROM v) GROUP BY leaf, a, word),
t AS (SELECT leaf, a, sum(docs) AS total, max({'docs': docs, 'word': word}) AS top FROM s GROUP BY leaf, a),
m AS (SELECT leaf, list(CASE WHEN top.docs >= 0.5 * total AND top.word <> '<*>' THEN top.word END ORDER BY a) AS tpl FROM t GROUP BY leaf),
g AS (SELECT v.leaf, v.sig FROM v JOIN m USING (leaf) WHERE len([i FOR i IN range(1, len(words) + 1) IF words[i] = tpl[i]]) >= 0.7 * len(words)),
often AS (SELECT leaf FROM l JOIN g USING (leaf, sig) GROUP BY leaf HAVING count(DISTINCT rid) >= 5),
gone AS (SELECT leaf, sig FROM c WHERE docs >= 5 AND (leaf, sig) NOT IN (SELECT (leaf, sig) FROM g)
  UNION ALL SELECT leaf, sig FROM g WHERE leaf IN (SELECT leaf FROM often)),
f AS (SELECT l.rid, l.pos, l.line, l.n > 0 AND gone.sig IS NOT NULL AS dropped FROM l LEFT JOIN gone USING (leaf, sig))
SELECT d.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM f JOIN d USING (rid) GROUP BY d.rid, d.doc_id
"""
