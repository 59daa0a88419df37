"""Mixing sources to target weights by exponential keys (Efraimidis-Spirakis).

Each document draws key = -ln(u) / quality, u from a hash of its id. Taking a source's documents by
ascending key is weighted sampling without replacement; prefix sums of their sizes in that order
meet the source's word budget. Complete epochs come first, the key order only settles the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_WORD, table, written

LETTERS = r"[^A-Za-z\x{80}-\x{10FFFF}]"


def letter_quality(text: Column) -> Column:
    """0.1 to 1: the share of letters (code points from U+0080 count as such) in the text."""
    n = F.length(text)
    return F.lit(0.1) + F.lit(0.9) * F.length(F.regexp_replace(text, LETTERS, "")) / F.greatest(n, F.lit(1))


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes(source, source_size) -> with target: sources by code point, null last, take the weights
    in turn and share `share` of all words; none gets over `cap` times its size and what is over is
    shared again by weight.

    Resharing ends at the level where capped sources have their cap and the others weight * level:
    found in one pass over the sources by ascending cap / weight. One row a source, so these
    unpartitioned windows hold the catalogue of sources, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    s = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(cap))).alias("most"))
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("left", F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    s = s.withColumn("capped", F.col("most") * F.sum("w").over(onward) <= F.col("w") * F.col("left"))
    used = F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0)).over(everything)
    free = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w"))).over(everything)
    level = (F.col("budget") - used) / F.when(free > 0, free)
    return s.select(
        "source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(F.col("w") * level).alias("target")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=(3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    whole: bool = False,
    seed: str = "mix",
    buckets: int = 128,
    quality: Column | None = None,
) -> DataFrame:
    """doc_id, source, size, source_size, target, quality, sample_key, taken for every row of docs.

    taken is in words, repeats counted. The document at the budget's edge gives the words that are
    left (whole=False), or all or none, whichever is nearer (whole=True). A null text has size 0; a
    null source is a source of its own; a null id hashes as ''; rows of one id share a key and go by
    size; an empty table gives no rows; other columns are ignored. quality: a weight over 0 for each row, by
    default the share of letters in its text; null and smaller ones count as 0.000001.

    A source is never gathered in one task: windows run in (source, bucket), and bucket sums carry the prefix
    across. Buckets cut the logarithm of the key, `buckets` to a doubling. As log(-ln(u) / quality) is
    log(-ln(u)) moved by the quality, and no range of that of width w holds over w / e of its draws, a bucket holds
    under ln(2) / e / buckets of its source (0.2 %), whatever its qualities are.
    """
    uid = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), uid)), 1, 12), 16, 10).cast("double") + 1) / F.lit(
        float(2**48)
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WHITE_WORD)).cast("long").alias("size"),
        (letter_quality(text) if quality is None else F.greatest(F.coalesce(quality, F.lit(0.0)), F.lit(1e-6))).alias("quality"),
        u.alias("u"),
    ).select("doc_id", "source", "size", "quality", (-F.log("u") / F.col("quality")).alias("sample_key"))
    slim = written(slim, "mix").withColumn(
        "bucket", F.floor(F.log2(F.greatest("sample_key", F.lit(1e-30))) * buckets).cast("int")
    )
    sums = written(slim.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "mixsums")
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, cap)
    goal = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("epochs", epochs).withColumn("rest", goal - F.col("epochs") * F.col("source_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
        .join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select("s", F.col("bucket").alias("b"), "before", "source_size", "target", "epochs", "rest")
    )
    inside = (
        Window.partitionBy("source", "bucket")
        .orderBy("sample_key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = slim.withColumn("in_bucket", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    room = F.col("rest") - F.col("before") - F.col("in_bucket")
    if whole:
        extra = F.when((room > 0) & (room * 2 >= F.col("size")), F.col("size")).otherwise(0)
    else:
        extra = F.greatest(F.lit(0), F.least(room, F.col("size")))
    return placed.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "quality",
        "sample_key",
        (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"),
    )


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document: the mix of all sources by weights 3, 1, 2 in turn,
    150 % of all words, no source over twice its size."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    0.1::DOUBLE + 0.9::DOUBLE * length(regexp_replace(coalesce(text, ''), '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) / greatest(length(coalesce(text, '')), 1) AS quality,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710656.0::DOUBLE AS u
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
    source_size * 2.0::DOUBLE AS most, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s0),
s2 AS (SELECT *, most * sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= w * (budget - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS capped FROM s1),
s3 AS (SELECT source, source_size, CASE WHEN capped THEN most ELSE w * ((budget - sum(CASE WHEN capped THEN most ELSE 0 END) OVER ())
    / nullif(sum(CASE WHEN capped THEN 0 ELSE w END) OVER (), 0)) END AS target FROM s2),
s4 AS (SELECT *, round(target)::BIGINT AS goal, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM s3),
k AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY -ln(u) / quality, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT k.doc_id, k.size, s4.source_size, s4.target,
  (epochs * size + greatest(0, least(goal - epochs * s4.source_size - before, size)))::BIGINT AS taken
FROM k JOIN s4 ON k.source IS NOT DISTINCT FROM s4.source
"""
