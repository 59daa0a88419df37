"""Histories of one object: differences between snapshots, merged records, fill-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import filled

TRACKED = {
    "node_id": "node",
    "desired_status": "desired_status",
    "client_status": "client_status",
    "previous_allocation": "previous_allocation",
    "next_allocation": "next_allocation",
    "eval_id": "eval_id",
    "deployment_id": "deployment_id",
}
FLAGGED = ["task_states", "desired_transition", "reschedule_tracker"]


def quoted(value: Column) -> Column:
    """A value as it stands in a difference: quoted text, None for null."""
    return F.coalesce(F.concat(F.lit("'"), value, F.lit("'")), F.lit("None"))


def differences(rows: DataFrame, key: list[str], order: list, tracked: dict[str, str], flagged: list[str] = ()) -> DataFrame:
    """rows with changes ('label: old -> new; ..') against the row before of the same key, and whether
    it is the first. Rows that change nothing stay, with ''."""
    w = Window.partitionBy(*key).orderBy(*order)
    before = lambda c: F.lag(F.col(c)).over(w)
    first = F.row_number().over(w) == 1
    parts = [F.when(~before(c).eqNullSafe(F.col(c)), F.concat(F.lit(label + ": "), quoted(before(c).cast("string")), F.lit(" -> "), quoted(F.col(c).cast("string")))) for c, label in tracked.items()]
    parts += [F.when(~before(c).eqNullSafe(F.col(c)), F.lit(c + " changed")) for c in flagged]
    return rows.withColumn("first", first).withColumn("changes", F.when(first, F.lit("")).otherwise(F.concat_ws("; ", *parts)))


def merge_by_id(rows: DataFrame, columns: list[str], key: str = "id", seq: str = "seq", interval: str = "interval_id", source: str = "source_file", sighted: Column | None = None) -> DataFrame:
    """One row an id: of each column the latest non-empty value, first and last interval in order of sight (in rows that are sighted, by
    default all), sources in order, each once. One pass; max_by pre-aggregates, so the shuffle carries one row a task and id."""
    sight = F.col(seq) if sighted is None else F.when(sighted, F.col(seq))
    latest = [F.max_by(c, F.when(filled(F.col(c).cast("string")).isNotNull(), F.col(seq))).alias(c) for c in columns]
    return rows.groupBy(key).agg(
        *latest, F.min_by(interval, sight).alias("first_seen_interval"), F.max_by(interval, sight).alias("last_seen_interval"), in_order(seq, source).alias("sources")
    )


def in_order(seq: str, source: str) -> Column:
    """Aggregate: the sources in order, each once."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(source).alias("f")))), lambda x: x["f"]))


def fill_missing(base: DataFrame, events: DataFrame, columns: list[str], key: str = "id", seq: str = "seq", source: str | None = None) -> DataFrame:
    """base with its empty columns filled by the first non-empty value that events have; ids that only events
    know are added. source: a column of events whose values are added to base's sources, behind them."""
    first = [F.min_by(c, F.when(filled(F.col(c).cast("string")).isNotNull(), F.col(seq))).alias("e_" + c) for c in columns]
    if source is not None:
        first.append(in_order(seq, source).alias("e_sources"))
    more = events.groupBy(key).agg(*first)
    own = lambda c: F.when(filled(F.col(c).cast("string")).isNotNull(), F.col(c))
    return base.join(more, key, "full").select(key, *[F.coalesce(own(c), F.col("e_" + c), F.col(c)).alias(c) for c in columns], *[(F.array_distinct(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in ("sources", "e_sources")])).alias(c) if c == "sources" and source is not None else c) for c in base.columns if c != key and c not in columns])
