"""Reported identifiers against captured records: observed rows and explicit not-observed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOT_OBSERVED = "not observed in captured state"


def observations(records: DataFrame, seeds: DataFrame) -> DataFrame:
    """records(.., fields array<struct<seed_type, value>>) and seeds(seed_type, seed_value) -> the records
    that carry a seed, a row for each. The join side is left to the planner: seeds are few, and go
    along only if they are known to be small."""
    spread = records.withColumn("f", F.explode("fields")).withColumn("seed_type", F.col("f.seed_type")).withColumn("seed_value", F.col("f.value")).drop("f", "fields")
    return spread.join(seeds, ["seed_type", "seed_value"]).withColumn("observation_state", F.lit("observed"))


def with_not_observed(observed: DataFrame, seeds: DataFrame) -> DataFrame:
    """observed, and for every seed it lacks a row that says so."""
    lacking = seeds.join(observed.select("seed_type", "seed_value").distinct(), ["seed_type", "seed_value"], "left_anti")
    return observed.unionByName(lacking.withColumn("observation_state", F.lit(NOT_OBSERVED)), allowMissingColumns=True)


def seed_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("observation_state").agg(F.count_distinct("seed_type", "seed_value").alias("seeds"))
