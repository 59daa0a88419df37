"""Time-window extraction: capture times of intervals, lines inside a window, the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timestamps import iso_utc, timestamps_in

#: Snapshot files in the order in which they may tell the capture time.
TIME_SOURCES = ["metrics.json", "allocations.json", "evaluations.json", "deployments.json", "jobs.json", "nodes.json", "operator-scheduler.json"]


def lines_inside(lines: DataFrame, start, end) -> DataFrame:
    """Lines with a timestamp inside [start, end], with the first and last such time."""
    inside = F.filter(timestamps_in(F.col("line")), lambda t: (t >= F.lit(start)) & (t <= F.lit(end)))
    out = lines.withColumn("inside", inside).where(F.size("inside") > 0)
    return out.withColumn("first_ts", F.array_min("inside")).withColumn("last_ts", F.array_max("inside")).drop("inside")


def line_manifest(inside: DataFrame) -> DataFrame:
    return inside.groupBy("path").agg(F.count("*").alias("matched_lines"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")).select(
        F.lit("filtered_lines").alias("action"),
        F.col("path").alias("relative_path"),
        "matched_lines",
        iso_utc(F.col("first_ts")).alias("detected_first_timestamp"),
        iso_utc(F.col("last_ts")).alias("detected_last_timestamp"),
        F.lit("complete source lines with timestamps inside requested window").alias("note"),
    )


def interval_times(texts: DataFrame) -> DataFrame:
    """texts(interval_id, name, text), of a file one or more -> interval_id, ts, time_source: the least timestamp of the
    first file, in order of TIME_SOURCES and then of name, that has any."""
    ts = F.array_min(timestamps_in(F.col("text")))
    files = texts.select("interval_id", "name", ts.alias("ts")).where("ts is not null").groupBy("interval_id", "name").agg(F.min("ts").alias("ts"))
    order = F.array_position(F.array(*[F.lit(n) for n in TIME_SOURCES]), F.col("name"))
    rank = F.struct(F.when(order > 0, order).otherwise(len(TIME_SOURCES) + 1).alias("o"), F.col("name").alias("n"))
    return files.withColumn("rank", rank).groupBy("interval_id").agg(F.min_by("ts", "rank").alias("ts"), F.min_by("name", "rank").alias("time_source"))
