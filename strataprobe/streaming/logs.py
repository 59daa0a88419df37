"""Log lines as a stream: the operators of the batch timeline over a file source, with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import is_debug_traffic, timeline_event
from ..functions.text import without_leading_stamp
from ..functions.timestamps import first_timestamp


def log_stream(spark: SparkSession, folder: str, pattern: str = "*.log", files_a_batch: int = 100) -> DataFrame:
    """line, path of new text files under a folder, empty lines included."""
    return (
        spark.readStream.option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_a_batch)
        .text(folder)
        .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))
    )


def classified(lines: DataFrame, include_debug_traffic: bool = False) -> DataFrame:
    """ts, event, message, path of lines that carry a time."""
    out = lines if include_debug_traffic else lines.where(~is_debug_traffic(F.col("line")))
    out = out.withColumn("ts", first_timestamp(F.col("line"))).where("ts is not null")
    return out.select("ts", timeline_event(F.col("line")).alias("event"), without_leading_stamp(F.col("line")).alias("message"), "path")


def deduplicated(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """One event for equal messages at equal times, whichever files they come from, as long as the watermark
    waits; older state is dropped."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["ts", "message"])


def event_counts(events: DataFrame, window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Events by kind in tumbling windows of event time."""
    span = F.window("ts", window)
    return events.withWatermark("ts", lateness).groupBy(span, "event").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event", "n")
