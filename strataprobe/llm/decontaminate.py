"""Benchmark decontamination: a prefix-filtered set join, in DataFrame functions throughout.

An item's windows are runs of `window` words; a window's tokens are its word shingles. A document
holds a window exactly if it holds all its shingles at consecutive positions, so any one of them is
a necessary prefix: the rarest over the corpus is taken. Its postings give candidate starts; length
and positional bounds drop those that do not fit the document; the neighbours of the posting verify
the rest, shingle by shingle. Words and shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

NOT_WORD = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
SHINGLE = 4
#: Shingles of the items up to which they are broadcast (16 bytes each); beyond it, the join shuffles.
BROADCAST_SHINGLES = 1_000_000


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased words [0-9a-z and code points from U+0080]."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), NOT_WORD), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(ascii_lower(w)))


def shingles(words: Column, q: int) -> Column:
    """Hashes of the q-word shingles, in order; empty if there are fewer words."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (q - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(F.lit(q), w, *[F.get(words, i + j) for j in range(1, q)]))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """win, L, q, tokens (its shingles in order), items: the distinct windows and whose they are."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), word_hashes(F.col(text_col)).alias("w"))
    n = F.size("w")
    length = F.least(n, F.lit(window))
    starts = F.sequence(F.lit(1), n - length + 1)
    runs = (
        words.where(n > 0)
        .select("item", length.alias("L"), "w", F.explode(starts).alias("s"))
        .select("item", "L", F.slice("w", F.col("s"), F.col("L")).alias("run"))
        .groupBy("L", "run")
        .agg(F.collect_set("item").alias("items"))
    )
    q = F.least(F.col("L"), F.lit(SHINGLE))
    tokens = F.lit(None).cast("array<bigint>")
    for k in range(1, SHINGLE + 1):
        tokens = F.when(q == k, shingles(F.col("run"), k)).otherwise(tokens)
    return runs.select(F.monotonically_increasing_id().alias("win"), "L", q.alias("q"), tokens.alias("tokens"), "items")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_words, n_hit, n_items, items (sorted strings), contaminated
    for every row of docs.

    A null or empty text has no words and no hits; an item without words has no window; one of fewer
    words than `window` is one window. Repeated rows get a row each. Null item ids count as ''.
    Items of equal windows are all reported. Other columns are ignored. Documents are read once; what
    is kept of them is a row each and the postings of benchmark shingles.
    """
    wins = written(item_windows(items, item_col, item_text_col, window), "windows")
    vocab = wins.select("q", F.explode("tokens").alias("sh")).distinct()
    n_vocab, *flags = wins.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)), *[F.coalesce(F.max((F.col("q") == k).cast("int")), F.lit(0)) for k in range(1, SHINGLE + 1)]).first()
    sizes = [k for k in range(SHINGLE, 0, -1) if flags[k - 1]] or [SHINGLE]
    small = n_vocab <= BROADCAST_SHINGLES
    vocab = F.broadcast(vocab) if small else vocab

    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    read = docs.select(F.col(id_col).alias("doc_id"), key.alias("text_key"), word_hashes(F.col(text_col)).alias("w")).select(
        "doc_id", "text_key", F.monotonically_increasing_id().alias("rid"), F.size("w").cast("long").alias("n_words"), "w"
    )
    rows = read.select("doc_id", "text_key", "rid", "n_words", F.posexplode_outer(F.concat(*[shingles(F.col("w"), q) for q in sizes])).alias("at", "h"))
    at = F.col("at").cast("long")
    pos, before = F.lit(None).cast("long"), F.lit(0).cast("long")
    for q in sizes:
        pos = F.when(F.col("q") == q, at - before).otherwise(pos)
        before = before + F.greatest(F.col("n_words") - (q - 1), F.lit(0))
    found = (
        rows.join(vocab, rows["h"] == vocab["sh"], "left")
        .where("at is null or at = 0 or sh is not null")
        .select("doc_id", "text_key", "rid", "n_words", (F.coalesce("at", F.lit(0)) == 0).alias("first"), "q", pos.alias("pos"), "sh")
    )
    found = written(found, "postings")
    postings = found.where("sh is not null").select("rid", "n_words", "q", "pos", "sh")

    freq = postings.groupBy("sh").agg(F.count("*").alias("freq"))
    tokens = wins.select("win", "L", F.posexplode("tokens").alias("off", "sh"))
    prefix = (
        tokens.join(freq, "sh")
        .groupBy("win", "L")
        .agg(F.count("*").alias("known"), F.min(F.struct("freq", "sh", "off")).alias("rarest"))
        .join(wins.select("win", "q", "tokens", "items"), "win")
        .where(F.col("known") == F.size("tokens"))  # a shingle that no document holds: no occurrence
        .select("win", "L", F.col("q").alias("wq"), "tokens", "items", F.col("rarest.sh").alias("psh"), F.col("rarest.off").alias("off"))
    )
    prefix = F.broadcast(prefix) if small else prefix
    near = Window.partitionBy("rid", "q").orderBy("pos").rowsBetween(-(window - 1), window - 1)
    around = postings.withColumn("near", F.collect_list(F.struct("pos", "sh")).over(near))
    start = F.col("pos") - F.col("off")
    wanted = F.transform("tokens", lambda t, j: F.struct((F.col("start") + j).alias("pos"), t.alias("sh")))
    hits = (
        around.join(prefix, (around["sh"] == prefix["psh"]) & (around["q"] == prefix["wq"]) & (start >= 0) & (start + F.col("L") <= F.col("n_words")))
        .withColumn("start", start)
        .where(F.size(F.array_except(wanted, F.col("near"))) == 0)
        .select("rid", "start", (F.col("start") + F.col("L")).alias("end"), "items")
    )
    earlier = Window.partitionBy("rid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(earlier), F.lit(0))))
    per_doc = (
        hits.withColumn("new", covered)
        .groupBy("rid")
        .agg(F.sum("new").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return (
        found.where("first")
        .select("doc_id", "text_key", "rid", "n_words")
        .join(per_doc, "rid", "left")
        .select("doc_id", "text_key", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), names.alias("items"), (n_hit > 0).alias("contaminated"))
    )


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document against all benchmark items."""
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS L FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, L, array_to_string(w[s:s + L - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - L + 2)) AS s FROM bl)),
pos AS (SELECT rid, L, s, array_to_string(w[s:s + L - 1], ' ') AS gram FROM (SELECT d.rid, d.w, x.L, unnest(range(1, len(d.w) - x.L + 2)) AS s FROM d, (SELECT DISTINCT L FROM win) x WHERE len(d.w) >= x.L)),
occ AS (SELECT pos.rid, pos.s, pos.L, win.item_id FROM pos JOIN win USING (L, gram)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + L)) AS p FROM occ) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM occ) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
