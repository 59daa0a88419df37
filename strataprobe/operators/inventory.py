"""What was captured and what is missing: file rows, time bounds, coverage, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import PROFILE_NAME, file_kind, file_roles, suffix
from ..functions.text import human_size
from ..functions.timestamps import timestamps_in


def file_rows(files: DataFrame) -> DataFrame:
    """files(path, length, sha256) -> the catalogue columns that need no content."""
    return files.select(
        "path",
        F.col("length").alias("size_bytes"),
        human_size(F.col("length")).alias("size_human"),
        F.when(suffix(F.col("path")) == "", "(none)").otherwise(suffix(F.col("path"))).alias("extension"),
        file_kind(F.col("path")).alias("kind"),
        file_roles(F.col("path")).alias("likely_role"),
        "sha256",
    )


def bounded_lines(lines: DataFrame, max_bytes: int | None = None, max_lines: int | None = None) -> DataFrame:
    """The lines of each file up to a number of bytes (the line that reaches it included) or lines. Where lines name the
    block they were read in, bytes are added up by block, so that no task orders more than one."""
    out = lines
    if max_lines is not None:
        out = out.where(F.col("line_no") <= max_lines)
    if max_bytes is not None:
        size = F.octet_length("line") + 1
        by = ["path", "block"] if "block" in lines.columns else ["path"]
        before = F.sum(size).over(Window.partitionBy(*by).orderBy("line_no")) - size
        if len(by) > 1:
            w = Window.partitionBy("path").orderBy("block")
            blocks = lines.groupBy(*by).agg(F.sum(size).alias("n")).withColumn("earlier", F.sum("n").over(w) - F.col("n")).where(F.col("earlier") < max_bytes).drop("n")
            out, before = out.join(blocks, by), before + F.col("earlier")
        out = out.withColumn("before", before).where(F.col("before") < max_bytes).drop("before", "earlier")
    return out


def time_bounds(lines: DataFrame) -> DataFrame:
    """path, line_count, first_ts, last_ts over all timestamps in the lines. Bounds are taken line by line, so
    nothing is spread before the aggregate."""
    stamps = timestamps_in(F.col("line"))
    return lines.withColumn("ts", stamps).groupBy("path").agg(F.count("*").alias("line_count"), F.min(F.array_min("ts")).alias("first_ts"), F.max(F.array_max("ts")).alias("last_ts"))


def role_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.split("likely_role", ",")).alias("role")).groupBy("role").agg(F.count("*").alias("files"))


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.count_if(F.col("kind") == "text").alias("text_files"))


def largest(rows: DataFrame, most: int = 25) -> DataFrame:
    return rows.orderBy(F.col("size_bytes").desc(), "path").limit(most)


def presence(rows: DataFrame, item: str, unit: str) -> DataFrame:
    """In how many units each item is there."""
    return rows.groupBy(item).agg(F.count_distinct(unit).alias("present_in"))


def gaps(ids: DataFrame, group: list[str], number: str) -> DataFrame:
    """Whole numbers between a group's least and greatest that it lacks, one row each. The steps between
    neighbours are looked at, so only what is missing is ever spread."""
    w = Window.partitionBy(*group).orderBy(number)
    steps = ids.select(*group, number).distinct().withColumn("up", F.lead(number).over(w)).where(F.col("up") > F.col(number) + 1)
    return steps.select(*group, F.explode(F.sequence(F.col(number) + 1, F.col("up") - 1)).alias("missing"))


def padded_gaps(ids: DataFrame, group: list[str], text_id: str) -> DataFrame:
    """gaps() over numbered names, padded to the widest name of the group; others are left out."""
    digits = ids.withColumn("width", F.max(F.length(text_id)).over(Window.partitionBy(*group))).where(F.regexp_like(text_id, F.lit("^[0-9]+$")))
    out = gaps(digits.withColumn("n", F.col(text_id).cast("long")), [*group, "width"], "n")
    return out.select(*group, F.lpad(F.col("missing").cast("string"), F.col("width"), F.lit("0")).alias("missing"))


def profile_ids(files: DataFrame) -> DataFrame:
    """files(path) -> side, entity, index of the profile dumps directly under server/<name> and client/<name>."""
    p = F.regexp_extract("path", r"(?:^|/)(server|client)/([^/]+)/([^/]+)$", 3)
    return (
        files.select(
            F.regexp_extract("path", r"(?:^|/)(server|client)/([^/]+)/[^/]+$", 1).alias("side"),
            F.regexp_extract("path", r"(?:^|/)(server|client)/([^/]+)/[^/]+$", 2).alias("entity"),
            F.regexp_extract(p, PROFILE_NAME, 1).alias("index"),
        )
        .where("index <> ''")
        .distinct()
    )


def profile_captures(files: DataFrame) -> DataFrame:
    """side, entity, ids, gaps, summary text of each entity's profile dumps."""
    ids = profile_ids(files)
    lacking = padded_gaps(ids, ["side", "entity"], "index").groupBy("side", "entity").agg(F.sort_array(F.collect_list("missing")).alias("gaps"))
    out = ids.groupBy("side", "entity").agg(F.sort_array(F.collect_set("index")).alias("ids")).join(lacking, ["side", "entity"], "left")
    none = F.coalesce(F.size("gaps"), F.lit(0)) <= 0
    text = F.concat(F.size("ids").cast("string"), F.lit(" capture indexes ("), F.element_at("ids", 1), F.lit("–"), F.element_at("ids", -1), F.lit(")"))
    return out.withColumn("summary", F.when(none, F.concat(text, F.lit("; no numeric gaps"))).otherwise(F.concat(text, F.lit("; missing: "), F.array_join("gaps", ", "))))
