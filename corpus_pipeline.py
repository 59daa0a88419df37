"""Corpus pipeline: quality, near-duplicates, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns what it keeps. Stages but the last return the columns of
docs, in their order, whatever else these are called; the last adds shard_id and shard_version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataprobe.llm.common import table, written
from strataprobe.llm.decontaminate import contamination
from strataprobe.llm.jaccard import jaccard_components
from strataprobe.llm.mixing import mix
from strataprobe.llm.quality import QualityModel, fit_quality, score_udf, training_labels
from strataprobe.llm.shards import shard

QUALITY_THRESHOLD = 0.3
WIDTH, PERCENT = 5, 80


def _columns(docs: DataFrame) -> list:
    return [F.col(f"d.`{c}`") for c in docs.columns]


def _text_key(name: str = "d.text"):
    return F.xxhash64(F.coalesce(F.col(name), F.lit("")))


def _model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> QualityModel:
    return fit_quality(docs, training_labels(table(spark, sf_dir, "labels")).select("doc_id", "quality"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str, model: QualityModel | None = None) -> DataFrame:
    """Keeps documents that the quality classifier, by default fitted on them, scores 0.3 or more."""
    return docs.where(score_udf(model or _model(spark, docs, sf_dir))(F.col("text")) >= QUALITY_THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the first by id and text (null ids last), of each group linked at a Jaccard similarity of
    0.8 over five-word shingles. Rows that share an id but no group each stand for themselves; of
    rows equal in id and text one stays. Documents without words are linked with nothing and stay, all of them."""
    found = jaccard_components(docs, width=WIDTH, percent=PERCENT).where("n_shingles > 0")
    found = written(found.select("doc_id", "text_key", "component_id", "component_text"), "dups")
    rows = found.groupBy("doc_id", "text_key").agg(
        F.min(~(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("component_text")))).alias("gone"), F.count("*").alias("times")
    )
    rows = written(rows.where("gone or times > 1").select(F.col("doc_id").alias("known_id"), "text_key", "gone"), "gone")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.known_id")) & (_text_key() == F.col("g.text_key"))
    kept = docs.alias("d").join(rows.alias("g"), same, "left_anti")
    repeated = rows.where("not gone")
    if repeated.take(1):
        once = docs.alias("d").join(repeated.alias("g"), same, "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.unionByName(once)
    return kept


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no 10-word window of a benchmark item."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select("text_key").distinct()
    return docs.alias("d").join(bad.alias("b"), _text_key() == F.col("b.text_key"), "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str, model: QualityModel | None = None) -> DataFrame:
    """Repeats or leaves out whole documents, so that sources meet their word targets; the score of the first stage's
    classifier (fitted on all documents, not on what is left of them) is their weight. Documents without words add none and
    go. Rows of one id, source and size share the copies of the best placed of them."""
    score = score_udf(model or _model(spark, table(spark, sf_dir, "documents"), sf_dir))(F.col("text"))
    taken = mix(docs, whole=True, quality=F.lit(0.1) + F.lit(0.9) * score).where("taken > 0")
    copies = F.max((F.col("taken") / F.col("size")).cast("int")).alias("copies")
    plan = taken.groupBy("doc_id", "source", "size").agg(copies)
    size = F.regexp_count(F.coalesce(F.col("d.text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    on = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.source").eqNullSafe(F.col("p.source")) & (size == F.col("p.size"))
    copy = "copy"
    while copy in {c.lower() for c in docs.columns}:
        copy += "_"
    return docs.alias("d").join(plan.alias("p"), on).select(*_columns(docs), F.explode(F.sequence(F.lit(1), F.col("p.copies"))).alias(copy)).drop(copy)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str, output: str | None = None) -> DataFrame:
    """Writes the documents as shards below output, by default a new place in the shared folder that outlives the
    session, and returns them as the committed manifest has them."""
    return shard(docs, output)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mixture),
    ("sharding", shards),
]

#: SQL can't express the classifier; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, output: str | None = None) -> DataFrame:
    """All stages over the documents; output: the root of the shard store."""
    docs = table(spark, sf_dir, "documents")
    model = _model(spark, docs, sf_dir)
    for _, stage in STAGES[:-1]:
        known = {"model": model} if stage in (quality_filter, mixture) else {}
        docs = written(stage(spark, docs, sf_dir, **known), "stage")
    return shards(spark, docs, sf_dir, output)
