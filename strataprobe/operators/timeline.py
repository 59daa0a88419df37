"""Merged timelines: filters, log dedupe, ordering, caps and the collapsed view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import is_debug_traffic, relevance, timeline_event
from ..functions.text import excerpt_first_of, without_leading_stamp
from ..functions.timestamps import first_timestamp, in_window, iso_utc
from .ordinals import running_sum, with_ordinal

COLUMNS = ["ts", "source_type", "source_file", "source_line", "object_type", "object_id", "event", "details", "relevance", "source_group"]


def time_order() -> list:
    """By time, rows without one last, then source and line."""
    return [F.col("ts").asc_nulls_last(), "source_type", "source_file", F.coalesce("source_line", F.lit(-1))]


def holds_any(text, needles: list[str]):
    """True if any needle occurs, or none is given."""
    found = F.lit(not needles)
    for n in needles:
        found = found | F.contains(text, F.lit(n))
    return found


def with_relevance(events: DataFrame) -> DataFrame:
    return events.withColumn("relevance", relevance(F.col("event"), F.col("details"), F.col("source_type")))


def merged(*parts: DataFrame) -> DataFrame:
    out = parts[0].select(*COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*COLUMNS))
    return out


def ordered(events: DataFrame) -> DataFrame:
    """By time, rows without one last, then source and line."""
    return events.orderBy(*time_order())


def matching_log_lines(lines: DataFrame, needles: list[str], start=None, end=None) -> DataFrame:
    """lines(path, side, line_no, line) that hold a needle and lie in the window, with ts and noise (traffic of
    the debug capture itself). The substring test stands before the timestamp parse."""
    hit = lines.where(holds_any(F.col("line"), needles)).withColumn("ts", first_timestamp(F.col("line")))
    return hit.where(in_window(F.col("ts"), start, end)).withColumn("noise", is_debug_traffic(F.col("line")))


def correlated_log_events(hits: DataFrame, needles: list[str], width: int = 700, keep: tuple[str, ...] = ()) -> DataFrame:
    """Equal messages at equal times, from whatever file, as one event. keep: message, n (how many lines), to be kept as columns."""
    place = F.struct("path", "line_no")
    groups = hits.groupBy("ts", without_leading_stamp(F.col("line")).alias("message")).agg(
        F.count("*").alias("n"),
        F.min(F.struct("path", "line_no", "line", "side")).alias("first"),
        F.sort_array(F.collect_set("path")).alias("paths"),
        F.sort_array(F.collect_set("side")).alias("sides"),
    )
    many = F.col("n") > 1
    line = F.col("first.line")
    return with_relevance(
        groups.select(
            "ts",
            F.when(many, "correlated_monitor_log").otherwise(F.concat(F.col("first.side"), F.lit("_monitor_log"))).alias("source_type"),
            F.when(many, F.array_join("paths", " + ")).otherwise(F.col("first.path")).alias("source_file"),
            F.when(~many, F.col("first.line_no")).alias("source_line"),
            F.lit("log").alias("object_type"),
            F.lit("").alias("object_id"),
            timeline_event(line).alias("event"),
            excerpt_first_of(line, needles, width).alias("details"),
            F.array_join("sides", ",").alias("source_group"),
            *keep,
        )
    )


def earliest(events: DataFrame, most: int) -> DataFrame:
    """The first rows by time, source and file: a top-k, no full sort."""
    return events.orderBy(F.col("ts").asc_nulls_last(), "source_type", "source_file").limit(most)


def first_by_place(hits: DataFrame, most: int) -> DataFrame:
    """The first rows by path and line."""
    return hits.orderBy("path", "line_no").limit(most)


def collapsed(events: DataFrame, order: list, signature, keep=None, partition: list | None = None) -> DataFrame:
    """Runs of neighbours with equal signature numbered as island. Rows for which keep holds are runs of
    their own. Without partition columns the order is that of the whole input: a bounded view only."""
    w = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(*order)
    sig = signature if keep is None else F.when(~keep, signature)
    out = events.withColumn("sig", sig)
    same = F.col("sig").isNotNull() & (F.col("sig") == F.lag("sig").over(w))
    return out.withColumn("step", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step", "sig")


def collapsed_view(events: DataFrame) -> DataFrame:
    """Consecutive unchanged snapshot rows as one row that names the span; other rows as they are, all in order, with their
    number as ordinal. Neighbours are met by their numbers, so no task orders the whole."""
    sig = F.concat_ws("\u0001", "object_type", "object_id", F.regexp_replace("details", r"interval \d{4}", "interval NNNN"))
    order = [*time_order(), "object_type", "object_id", "event", "details"]
    rows = with_ordinal(events, order).withColumn("sig", F.when(F.col("source_type") == "interval_snapshot", sig))
    before = rows.select((F.col("ordinal") + 1).alias("ordinal"), F.col("sig").alias("sig_before"))
    step = F.when(F.coalesce(F.col("sig") == F.col("sig_before"), F.lit(False)), 0).otherwise(1)
    runs = running_sum(rows.join(before, "ordinal", "left"), step, "ordinal", "island")
    row = F.struct("ordinal", *[F.col(c).alias("v_" + c) for c in COLUMNS])
    g = runs.groupBy("island").agg(F.count("*").alias("n"), F.min(row).alias("a"), F.max(row).alias("z"))
    v = lambda c: F.col(f"a.v_{c}")
    many = F.col("n") > 1
    span = F.concat(v("details"), F.lit("; unchanged across "), F.col("n").cast("string"), F.lit(" captured interval observations from "), iso_utc(v("ts")), F.lit(" through "), iso_utc(F.col("z.v_ts")))
    changed = {
        "source_file": F.concat(v("source_file"), F.lit(" … "), F.col("z.v_source_file")),
        "source_line": F.lit(None).cast("int"),
        "event": F.concat(v("object_type"), F.lit(" state unchanged across "), F.col("n").cast("string"), F.lit(" intervals")),
        "details": span,
        "source_group": F.lit(""),
    }
    shown = [F.when(many, changed[c]).otherwise(v(c)).alias(c) if c in changed else v(c).alias(c) for c in COLUMNS]
    return g.select(*shown, (F.col("island") - 1).alias("ordinal")).orderBy("ordinal")
