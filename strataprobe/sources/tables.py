"""The parquet test tables in the canonical schemas of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(ntz: Column) -> Column:
    """The instant of a wall-clock time that is meant in UTC, whatever the session's zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ntz).cast("timestamp")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", utc(F.col("ts")))


def event_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as timeline rows; errors count as failed."""
    e = events(spark, sf_dir)
    return e.select(
        "ts",
        F.lit("eventstream").alias("source_type"),
        F.lit("events").alias("source_file"),
        F.col("event_id").cast("int").alias("source_line"),
        F.lit("user").alias("object_type"),
        F.col("user_id").cast("string").alias("object_id"),
        F.when(F.col("event_type") == "error", "event failed").otherwise(F.col("event_type")).alias("event"),
        F.concat(F.lit("props="), F.col("props")).alias("details"),
        F.lit("").alias("source_group"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.search import numbered_lines

    return numbered_lines(table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string")), "path", "text")
