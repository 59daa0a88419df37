"""The nine investigations over a captured tree, each from scan to report files.

Each returns the run directory (or the output directory) and leaves CSV, JSON and Markdown in it. Sources are only
read. Input problems raise InputError (exit code 2); a seed that can't be resolved raises SeedError (3).
"""

from __future__ import annotations

import re
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, records, text, timestamps
from ..operators import changes, graphs, inventory, links, ordinals, review, search, timeline, windows
from ..sources import bundles, ingest, placed, sinks, splits

STREAM = "cluster/eventstream.json"


class InputError(ValueError):
    """The bundle, an argument or the output directory is not usable."""


class SeedError(LookupError):
    """The seed has nothing to start from."""


def need_bundle(root: str | Path) -> tuple[Path, Path]:
    root = Path(root)
    found = bundles.find_bundle(root)
    if found is None:
        raise InputError(f"no bundle, or more than one, at {root}")
    return root, found


def need_uuid(value: str) -> str:
    if not re.match(classify.UUID, value):
        raise InputError(f"{value!r} is not a UUID")
    return value


def stamp(at: datetime | None) -> str:
    return at.strftime("%Y%m%dT%H%M%SZ") if at else ""


def stream_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("rel").rlike("(^|/)" + re.escape(STREAM) + "$"))


# 1 -----------------------------------------------------------------------------------------------
def inventory_bundle(spark: SparkSession, root: str, output: str, max_scan_mb: int | None = 50, max_lines: int | None = 250_000, top_largest: int = 25) -> Path:
    """Catalogue of files with kind, roles, hash and time span, and the bundle's coverage and gaps. Without a limit (None)
    times are looked for in every file to its end."""
    root_p, out = Path(root), Path(output)
    if not root_p.is_dir():
        raise InputError(f"{root} is no directory")
    out.mkdir(parents=True, exist_ok=True)
    files = bundles.listing(spark, root, [out])
    rows = inventory.file_rows(files.join(ingest.hashed(files), "rel").select(F.col("rel").alias("path"), "length", "sha256"))
    texts = files.where(classify.file_kind(F.col("rel")) == "text")
    lines = ingest.text_lines(texts)
    limit = None if max_scan_mb is None else max_scan_mb << 20
    table = rows.join(inventory.time_bounds(inventory.bounded_lines(lines, limit, max_lines)), "path", "left")
    reasons = F.lit("")
    if limit is not None:
        reasons = F.concat_ws(",", F.when(F.col("size_bytes") > limit, F.lit(f"byte_limit={max_scan_mb}.0 MB")))
    if max_lines is not None:
        table = table.join(lines.groupBy("path").agg(F.count("*").alias("all_lines")), "path", "left")
        reasons = F.concat_ws(",", F.when(reasons != "", reasons), F.when(F.col("all_lines") > max_lines, F.lit(f"line_limit={max_lines}")))
    status = F.when(F.col("kind") != "text", "not_scanned").when(reasons == "", "full_scan").otherwise(F.concat(F.lit("partial_scan:"), reasons))
    table = table.select(
        F.col("path").alias("relative_path"), "size_bytes", "size_human", "extension", "kind", "likely_role", "sha256",
        F.when(status == "full_scan", F.coalesce("line_count", F.lit(0))).alias("line_count"), timestamps.iso_utc(F.col("first_ts")).alias("first_timestamp"), timestamps.iso_utc(F.col("last_ts")).alias("last_timestamp"),
        status.alias("scan_status"),
    ).orderBy("relative_path").cache()
    sinks.csv_file(table, out / "inventory.csv")
    cover = bundles.coverage(bundles.find_bundle(root_p))
    captures = sinks.rows_of(inventory.profile_captures(files.select(F.col("rel").alias("path"))))
    ids = spark.createDataFrame([(i,) for i in cover["interval_ids"]], "id string")
    cover["missing_interval_ids"] = [r["missing"] for r in inventory.padded_gaps(ids.withColumn("g", F.lit(1)), ["g"], "id").orderBy("missing").collect()]
    cover["interval_artifacts"] = sorted(cover["interval_artifact_presence"])
    for side in ("server", "client"):
        cover[f"{side}_profile_ids"] = {c["entity"]: c["ids"] for c in captures if c["side"] == side}
    sinks.json_file(cover, out / "bundle_summary.json")
    totals = table.agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.count_if(F.col("kind") == "text").alias("text files"), F.count_if(F.col("first_timestamp") != "").alias("with timestamps"))
    sinks.markdown_file(
        out / "inventory.md", "Captured files",
        ("Totals", totals), ("Kinds", table.groupBy("kind").count().orderBy("kind")), ("Roles", inventory.role_counts(table).orderBy(F.col("files").desc(), "role")),
        ("Largest files", inventory.largest(table.withColumn("path", F.col("relative_path")), top_largest).select("relative_path", "size_human")),
        ("Coverage", sinks.markdown_table(["what", "value"], cover.items())), ("Profile captures", sinks.markdown_table(["side", "entity", "captures"], ((c["side"], c["entity"], c["summary"]) for c in captures)) if captures else "none detected"),
        ("All files", table.select("relative_path", "size_human", "kind", "likely_role", "first_timestamp", "last_timestamp", "scan_status")),
    )
    table.unpersist()
    return out


# 2 -----------------------------------------------------------------------------------------------
def find_identifiers(spark: SparkSession, root: str, ids: list[str], output: str, ignore_case: bool = False, samples_per_file: int = 3, sample_width: int = 500) -> Path:
    """Exact occurrences of identifiers in all text files: counts, lines, samples."""
    out = Path(output)
    if not Path(root).is_dir() or not ids or any(not x for x in ids):
        raise InputError("a directory and at least one non-empty identifier are needed")
    out.mkdir(parents=True, exist_ok=True)
    files = bundles.listing(spark, root, [out]).where(classify.searchable(F.col("rel")))
    matches = search.line_matches(ingest.text_lines(files), ids, ignore_case).cache()
    counts = search.match_counts(matches).withColumn("category", classify.path_category(F.col("path")))
    ranked = search.ranked_matches(counts).select(
        "identifier", F.col("path").alias("relative_path"), "category", "match_count", "matching_lines", F.col("first_line").alias("first_match_line"), F.col("last_line").alias("last_match_line")
    )
    sinks.csv_file(ranked, out / "results.csv")
    totals = sinks.rows_of(search.match_totals(counts))
    wanted = list(dict.fromkeys(ids))
    results = {i: {"occurrences": 0, "matching_files": 0, "occurrences_by_category": {}} for i in wanted}
    for t in totals:
        r = results[t["identifier"]]
        r["occurrences"] += t["occurrences"]
        r["matching_files"] += t["files"]
        r["occurrences_by_category"][t["category"]] = t["occurrences"]
    errors = sinks.rows_of(ingest.unreadable(files).orderBy("rel"))
    sinks.json_file({"identifiers": wanted, "searchable_files_scanned": files.count(), "read_errors": len(errors), "unreadable": errors, "results": results}, out / "summary.json")
    samples = search.match_samples(matches, samples_per_file, sample_width, ignore_case).orderBy("identifier", "path", "line_no")
    telling = F.col("category") != "metrics"
    unread = [("Read errors", f"{len(errors)} files could not be searched.\n\n" + sinks.first_of([f"`{sinks.cell(e['rel'])}`: {e['error']}" for e in errors], 100, "errors"))] if errors else []
    sinks.markdown_file(
        out / "results.md", "Identifier search", ("Matches", ranked.where(telling)), ("Matches in metrics", ranked.where(~telling)), ("Samples", samples.select("identifier", "path", "line_no", "excerpt")), *unread
    )
    matches.unpersist()
    return out


# 3 -----------------------------------------------------------------------------------------------
def extract_window(spark: SparkSession, root: str, output: str, start: datetime, end: datetime, include_static: bool = False, include_profiles: bool = False, overwrite: bool = False) -> Path:
    """Interval snapshots captured inside a window, whole, and the lines of text files with a time inside it."""
    root_p = Path(root)
    if not root_p.is_dir() or end < start:
        raise InputError("a directory and a window that ends after it starts are needed")
    run = sinks.run_directory(Path(output) / f"{stamp(start)}_{stamp(end)}", overwrite)
    extracted = run / "extracted"
    bundle = bundles.find_bundle(root_p)
    files = bundles.listing(spark, root, [run]).cache()
    none = spark.createDataFrame([], "rel string, action string, note string")
    picked, chosen, unread = none, [], []
    if bundle is not None:
        name = F.regexp_extract("rel", ingest.SNAPSHOT, 2)
        direct = files.where((name != "") & classify.suffix(F.col("rel")).isin(classify.TEXT_SUFFIXES))
        texts = ingest.stretches(direct).select(F.regexp_extract("rel", ingest.SNAPSHOT, 1).alias("interval_id"), F.regexp_extract("rel", ingest.SNAPSHOT, 2).alias("name"), "text")
        times = sinks.rows_of(windows.interval_times(texts))
        chosen = sorted((t for t in times if start <= t["ts"].replace(tzinfo=start.tzinfo) <= end), key=lambda t: t["interval_id"])
        unread = sorted(set(bundles.interval_ids(bundle)) - {t["interval_id"] for t in times})
        ids = [t["interval_id"] for t in chosen]
        within = F.regexp_extract("rel", r"(?:^|/)interval/([0-9]+)/", 1).isin(ids or [""])
        note = F.concat(F.lit("interval "), F.regexp_extract("rel", r"(?:^|/)interval/([0-9]+)/", 1))
        picked = files.where(within).select("rel", F.lit("copied_interval_snapshot").alias("action"), note.alias("note"))
        if include_static:
            static = F.col("rel").rlike(r"(^|/)cluster/|(^|/)(server|client)/[^/]+/agent-host\.json$|(^|/)index\.json$")
            picked = picked.unionByName(files.where(static & ~within).select("rel", F.lit("copied_static").alias("action"), F.lit("bundle metadata, not filtered by time").alias("note")))
        if include_profiles:
            index = F.regexp_extract(F.regexp_extract("rel", r"(?:^|/)(?:server|client)/[^/]+/([^/]+)$", 1), classify.PROFILE_NAME, 1)
            picked = picked.unionByName(files.where(index.isin(ids or [""]) & (index != "")).select("rel", F.lit("copied_profile").alias("action"), F.concat(F.lit("profile index "), index).alias("note")))
    picked = picked.dropDuplicates(["rel"]).cache()
    sinks.copied(picked.join(files.select("rel", "path"), "rel").select("rel", "path"), extracted)
    rel, ext = F.col("rel"), classify.suffix(F.col("rel"))
    scanned = files.join(picked, "rel", "left_anti").where(ext.isin(classify.TEXT_SUFFIXES) & ~F.regexp_like(classify.file_name(rel), F.lit(classify.DUMP_NAME)) & ((ext != ".json") | (classify.file_name(rel) == "eventstream.json")))
    inside = windows.lines_inside(ingest.text_lines(scanned), start, end).cache()
    placed.write_placed(inside.select(F.col("path").alias("file"), F.concat("line", F.lit("\n")).alias("data"), "line_no"), extracted, ["file", "line_no"])
    copied = picked.select("action", F.col("rel").alias("relative_path"), F.lit(None).cast("long").alias("matched_lines"), F.lit("").alias("detected_first_timestamp"), F.lit("").alias("detected_last_timestamp"), "note")
    got = bundles.listing(spark, extracted) if extracted.exists() else spark.createDataFrame([], bundles.LISTING)
    source = files.join(ingest.hashed(files), "rel").select(rel.alias("relative_path"), F.col("length").alias("source_size_bytes"), F.col("sha256").alias("source_sha256"))
    result = got.join(ingest.hashed(got), "rel").select(rel.alias("relative_path"), F.col("length").alias("output_size_bytes"), F.col("sha256").alias("output_sha256"))
    rows = copied.unionByName(windows.line_manifest(inside)).join(source, "relative_path").join(result, "relative_path", "left")
    rows = rows.select("action", "relative_path", "source_size_bytes", "output_size_bytes", "source_sha256", "output_sha256", "matched_lines", "detected_first_timestamp", "detected_last_timestamp", "note").orderBy("action", "relative_path").cache()
    sinks.csv_file(rows, run / "manifest.csv")
    counts = {r["action"]: r["count"] for r in rows.groupBy("action").count().collect()}
    summary = {"window_utc": [start.isoformat(), end.isoformat()], "selected_intervals": [t["interval_id"] for t in chosen], "unparsed_intervals": unread, "actions": counts}
    sinks.json_file(summary, run / "summary.json")
    sinks.markdown_file(run / "summary.md", "Extracted window", ("Window", f"{start.isoformat()} to {end.isoformat()}"), ("Intervals", sinks.markdown_table(["interval", "time", "source"], ((t["interval_id"], t["ts"], t["time_source"]) for t in chosen))), ("Manifest", rows))
    for df in (files, picked, inside, rows):
        df.unpersist()
    return run


# shared pieces of the object tools ---------------------------------------------------------------
PROBE = 65_536  # characters at the head of a snapshot that may tell its time


def capture_times(files: DataFrame, strict: bool) -> DataFrame:
    """interval_id, capture_ts. strict: the metrics' own time only; else, failing that, the least time at the
    head of allocations, evaluations or nodes, the first of these that has one."""
    name = F.regexp_extract("rel", ingest.SNAPSHOT, 2)
    head = ingest.whole_texts(files.where(name == "metrics.json"))
    if not strict:
        head = head.unionByName(ingest.whole_texts(files.where(name.isin("allocations.json", "evaluations.json", "nodes.json")), chars=PROBE))
    head = head.select(F.regexp_extract("rel", ingest.SNAPSHOT, 1).alias("interval_id"), F.regexp_extract("rel", ingest.SNAPSHOT, 2).alias("name"), "text")
    order = F.array_position(F.array(*[F.lit(n) for n in ("metrics.json", "allocations.json", "evaluations.json", "nodes.json")]), F.col("name"))
    own = timestamps.parse_timestamp(F.get_json_object("text", "$.Timestamp"))
    probe = F.array_min(timestamps.timestamps_in(F.col("text")))
    ts = F.when(F.col("name") == "metrics.json", own).otherwise(probe)
    seen = head.select("interval_id", order.alias("o"), ts.alias("ts")).where("ts is not null")
    return seen.groupBy("interval_id").agg(F.min_by("ts", "o").alias("capture_ts"))


def stream_rows(files: DataFrame, needles: list[str] = ()) -> DataFrame:
    """The event stream's records; needles: those that hold none of them need not be there."""
    return ingest.event_records(stream_files(files), needles=needles)


def stream_labels(record) -> dict:
    name = lambda key, other: F.coalesce(records.filled(records.get(record, key)), F.lit(other))
    keys = records.filled(records.get(record, "FilterKeys"))
    return {"topic": name("Topic", "Unknown"), "type": name("Type", "Unknown"), "index": F.concat(F.lit("index="), records.get(record, "Index")), "keys": F.concat(F.lit("filter_keys="), text.truncated(keys, 220))}


def some(column):
    return F.when(column != "", column)


def stats_of(snaps: DataFrame) -> dict:
    files = snaps.groupBy("artifact", "mode").agg(F.count_distinct("rel").alias("files"), F.count("record_json").alias("records")).collect()
    out: dict = {"parse_modes": {}, "records_read": {}}
    for r in files:
        out["parse_modes"][f"{r['artifact']}:{r['mode']}"] = r["files"]
        out["records_read"][r["artifact"]] = out["records_read"].get(r["artifact"], 0) + r["records"]
    return out


# 4 -----------------------------------------------------------------------------------------------
def alloc_history(spark: SparkSession, root: str, alloc: str, output: str, samples: int = 100, line_width: int = 700, overwrite: bool = False) -> Path:
    """One allocation's history from snapshots (changes only), event stream and log lines."""
    need_uuid(alloc)
    root_p = Path(root)
    if not root_p.is_dir():
        raise InputError(f"{root} is no directory")
    run = sinks.run_directory(Path(output) / alloc, overwrite)
    files = bundles.listing(spark, root).cache()
    rec = F.col("record_json")
    snaps = ingest.snapshots(files, ["allocations.json"], deep_id=(records.DEEP_IDS, alloc)).cache()
    found = snaps.where("record_json is not null").join(capture_times(files, strict=False), "interval_id", "left")
    flat = found.select("interval_id", F.col("rel").alias("source_file"), "elem_idx", "capture_ts", *[c.alias(n) for n, c in records.allocation_summary(rec).items()]).cache()
    order = [F.col("interval_id").cast("long"), "source_file", "elem_idx"]
    diff = changes.differences(flat.withColumn("one", F.lit(1)), ["one"], order, changes.TRACKED, changes.FLAGGED)
    named = {"interval": "interval_id", "job": "job_id", "group": "task_group", "node": "node_id", "desired": "desired_status", "client": "client_status", "create_time": "create_time_utc", "modify_time": "modify_time_utc"}
    seen = F.concat_ws(" ", *[F.concat(F.lit(k + "="), F.coalesce(F.col(c), F.lit(""))) for k, c in named.items()])
    changed = F.concat("changes", F.lit("; allocation_modify_time="), F.coalesce("modify_time_utc", F.lit("")))
    blank = F.lit(None).cast("int")
    snap_events = diff.where("first or changes <> ''").select(
        F.col("capture_ts").alias("ts"), F.lit("allocation_snapshot").alias("source_type"), "source_file", blank.alias("source_line"),
        F.when(F.col("first"), "allocation observed in interval snapshot").otherwise(F.concat(F.lit("snapshot change at interval "), "interval_id")).alias("event"), F.when(F.col("first"), seen).otherwise(changed).alias("details"),
    )
    stream = stream_rows(files, [alloc]).where((records.get(rec, "Key") == alloc) | F.contains(rec, F.lit(alloc))).cache()
    label = stream_labels(rec)
    payload = F.coalesce(records.get(rec, "Payload.Allocation"), F.lit("{}"))
    stream_events = stream.select(
        records.event_time(rec, ["Allocation"], payload_level=True).alias("ts"), F.lit("event_stream").alias("source_type"), F.col("rel").alias("source_file"), F.col("line_no").alias("source_line"),
        F.concat(label["topic"], F.lit(" / "), label["type"]).alias("event"), F.concat_ws("; ", label["index"], some(records.payload_details(payload)), label["keys"]).alias("details"),
    )
    rel = F.col("rel")
    sources = files.where(~rel.rlike("(^|/)" + re.escape(STREAM) + "$") & ~F.regexp_like(classify.file_name(rel), F.lit(classify.DUMP_NAME)) & ((classify.file_name(rel) == "monitor.log") | classify.suffix(rel).isin(classify.LINE_SUFFIXES)))
    hits = ingest.text_lines(sources).where(F.contains("line", F.lit(alloc))).cache()
    line_events = timeline.first_by_place(hits, samples).select(
        timestamps.first_timestamp(F.col("line")).alias("ts"), F.when(classify.file_name(F.col("path")) == "monitor.log", "monitor_log").otherwise("text_source").alias("source_type"), F.col("path").alias("source_file"),
        F.col("line_no").alias("source_line"), classify.history_event(F.col("line")).alias("event"), text.excerpt_around(F.col("line"), F.lit(alloc), line_width).alias("details"),
    )
    events = timeline.ordered(snap_events.unionByName(stream_events).unionByName(line_events)).cache()
    shown = events.select(timestamps.iso_utc(F.col("ts")).alias("timestamp_utc"), "source_type", "source_file", "source_line", "event", "details")
    n = sinks.csv_file(shown, run / "timeline.csv")
    first = flat.orderBy(*order).limit(1).collect()
    fields = ["job_id", "namespace", "task_group", "node_id", "node_name", "eval_id", "deployment_id", "previous_allocation", "next_allocation", "create_time_utc"]
    summary = {"allocation_id": alloc, **{f: first[0][f] if first else None for f in fields}}
    own = records.allocation_summary(payload)
    later = stream.where(records.get(rec, "Payload.Allocation").isNotNull()).select("line_no", *[own[f].alias(f) for f in fields])
    filler = later.agg(*[F.min_by(f, F.when(records.filled(F.col(f)).isNotNull(), F.col("line_no"))).alias(f) for f in fields]).first()
    for f in fields:
        if summary[f] in (None, ""):
            summary[f] = filler[f] if filler[f] is not None else summary[f]
    total = hits.count()
    summary |= {"snapshot_count": flat.count(), "timeline_event_count": n, "matching_lines": total, "retained_lines": min(total, samples)} | stats_of(snaps)
    sinks.json_file(summary, run / "summary.json")
    sinks.json_file(flat.orderBy(*order), run / "snapshots.json")
    sinks.json_file([r["record_json"] for r in sinks.rows_of(stream.orderBy("line_no"))], run / "eventstream.json")
    sinks.markdown_file(run / "timeline.md", f"History of allocation {alloc}", ("Summary", sinks.markdown_table(["field", "value"], summary.items())), ("Timeline", shown))
    for df in (files, snaps, flat, stream, hits, events):
        df.unpersist()
    return run


# 5 -----------------------------------------------------------------------------------------------
OBJECTS = {"allocations.json": ("allocation", records.ALLOCATION_IDS, records.allocation_details), "evaluations.json": ("evaluation", records.EVALUATION_IDS, records.evaluation_details), "nodes.json": ("node", records.NODE_IDS, records.node_details)}


def snapshot_timeline(files: DataFrame, snaps: DataFrame, needles: list[str], start, end) -> DataFrame:
    rec = F.col("record_json")
    kept = snaps.where("record_json is not null").where(timeline.holds_any(rec, needles)).join(capture_times(files, strict=True), "interval_id", "left")
    kept = kept.where(timestamps.in_window(F.col("capture_ts"), start, end))
    kind, oid, details = F.lit(None).cast("string"), F.lit("").cast("string"), F.lit("")
    for name, (what, ids, show) in OBJECTS.items():
        is_it = F.col("artifact") == name
        kind, oid, details = F.when(is_it, what).otherwise(kind), F.when(is_it, records.first_present(rec, ids)).otherwise(oid), F.when(is_it, show(rec)).otherwise(details)
    return timeline.with_relevance(
        kept.select(
            F.col("capture_ts").alias("ts"), F.lit("interval_snapshot").alias("source_type"), F.col("rel").alias("source_file"), F.lit(None).cast("int").alias("source_line"), kind.alias("object_type"), F.coalesce(oid, F.lit("")).alias("object_id"),
            F.concat(kind, F.lit(" observed in interval "), "interval_id").alias("event"), details.alias("details"), F.lit("").alias("source_group"),
        )
    )


def stream_timeline(files: DataFrame, needles: list[str], start, end) -> DataFrame:
    rec = F.col("record_json")
    label = stream_labels(rec)
    inner = [(records.get(rec, "Payload." + k), show) for k, show in (("Allocation", records.allocation_details), ("Evaluation", records.evaluation_details), ("Node", records.node_details))]
    shown = F.coalesce(*[F.when(o.isNotNull() & (o != "null"), show(o)) for o, show in inner])
    rows = stream_rows(files, needles).where(timeline.holds_any(rec, needles)).withColumn("ts", records.event_time(rec, ["Allocation", "Evaluation", "Node"])).where(timestamps.in_window(F.col("ts"), start, end))
    return timeline.with_relevance(
        rows.select(
            "ts", F.lit("event_stream").alias("source_type"), F.col("rel").alias("source_file"), F.col("line_no").alias("source_line"), F.lower(label["topic"]).alias("object_type"), F.coalesce(records.get(rec, "Key"), F.lit("")).alias("object_id"),
            F.concat(label["topic"], F.lit(" / "), label["type"]).alias("event"), F.concat_ws("; ", label["index"], some(shown), label["keys"]).alias("details"), F.lit("").alias("source_group"),
        )
    )


def log_hits(files: DataFrame, needles: list[str], start, end) -> DataFrame:
    logs = files.where(F.col("rel").rlike(r"(^|/)(server|client)/[^/]+/monitor\.log$"))
    lines = ingest.text_lines(logs).withColumn("side", F.regexp_extract("path", r"(?:^|/)(server|client)/[^/]+/monitor\.log$", 1))
    return timeline.matching_log_lines(lines, needles, start, end)


def correlate_timeline(
    spark: SparkSession, root: str, output: str, allocs: list[str] = (), nodes: list[str] = (), evals: list[str] = (), jobs: list[str] = (), texts: list[str] = (),
    start: datetime | None = None, end: datetime | None = None, max_log_matches: int = 500, line_width: int = 700, include_debug_traffic: bool = False, overwrite: bool = False,
) -> Path:
    """Event stream, snapshots and logs in one timeline; any of the identifiers or texts lets a row in."""
    root_p, bundle = need_bundle(root)
    if start and end and end < start:
        raise InputError("the window ends before it starts")
    groups = {"alloc": list(allocs), "node": list(nodes), "eval": list(evals), "job": list(jobs), "text": list(texts)}
    needles = list(dict.fromkeys(v for values in groups.values() for v in values if v))
    name = [f"{stamp(start) or 'begin'}_{stamp(end) or 'end'}"] if start or end else []
    name += [f"{k}-{text.slug(v[0], 40, '_')}" for k, v in groups.items() if v]
    run = sinks.run_directory(Path(output) / ("__".join(name) or "all-events"), overwrite)
    files = bundles.listing(spark, root, [output]).cache()
    snaps = ingest.snapshots(files, list(OBJECTS)).cache()
    hits = log_hits(files, needles, start, end).cache()
    kept = hits if include_debug_traffic else hits.where(~F.col("noise"))
    logs = timeline.earliest(timeline.correlated_log_events(kept, needles, line_width), max_log_matches)
    found = graphs.cut(timeline.merged(stream_timeline(files, needles, start, end), snapshot_timeline(files, snaps, needles, start, end), logs))  # a sort reads what it sorts twice
    events = timeline.ordered(found).cache()
    show = lambda df: df.select(timestamps.iso_utc(F.col("ts")).alias("timestamp_utc"), *timeline.COLUMNS[1:])
    n = sinks.csv_file(show(events), run / "timeline.csv")
    summary = {
        "filters": groups, "window_utc": [str(start or ""), str(end or "")], "events": n, "by_source": {r[0]: r[1] for r in events.groupBy("source_type").count().collect()}, "by_relevance": {r[0]: r[1] for r in events.groupBy("relevance").count().collect()},
        "monitor_matches": kept.count(), "suppressed_debug_lines": 0 if include_debug_traffic else hits.where("noise").count(), **stats_of(snaps),
    }
    sinks.json_file(summary, run / "summary.json")
    sinks.markdown_file(run / "timeline.md", "Correlated timeline", ("Summary", sinks.markdown_table(["what", "value"], summary.items())), ("Timeline, unchanged snapshots as one row", show(timeline.collapsed_view(events))))
    for df in (files, snaps, hits, events):
        df.unpersist()
    return run


# 6, 7 --------------------------------------------------------------------------------------------
#: Texts that records are looked through for; of more only the kind is looked for.
NEEDLES = 16


def entity_records(files: DataFrame, snaps: DataFrame, kind: str, needles: list[str] = ()) -> DataFrame:
    """Records of snapshots and, of that kind, of event payloads, with the place of each. needles: those that hold none of them need
    not be there."""
    rec = F.col("record_json")
    seen = snaps.where("record_json is not null").where(ingest.may_hold(rec, list(needles))).select("record_json", "interval_id", F.col("rel").alias("source_file"), F.struct(F.lit(0).alias("k"), F.col("interval_id"), F.col("elem_idx").cast("long").alias("n")).alias("seq"))
    inner = records.get(rec, "Payload." + kind)
    later = stream_rows(files, list(needles) or [f'"{kind}"']).withColumn("record_json", inner).where(rec.isNotNull() & (rec != "null"))
    return seen.unionByName(later.select("record_json", F.lit("").alias("interval_id"), F.concat("rel", F.lit(":"), F.col("line_no").cast("string")).alias("source_file"), F.struct(F.lit(1).alias("k"), F.lit("").alias("interval_id"), F.col("line_no").cast("long").alias("n")).alias("seq")))


def flat_entities(found: DataFrame, summary, known: list[str] | None = None) -> DataFrame:
    """The columns of entity_records(), by default all of the summary's, with their places; records without an id are none."""
    rec = F.col("record_json")
    rows = found.withColumn("known", records.members(rec))
    columns = {n: c for n, c in summary(rec, F.col("known")).items() if known is None or n in known}
    return rows.select("interval_id", "source_file", "seq", *[c.alias(n) for n, c in columns.items()]).where("id <> ''")


def merged_entities(files: DataFrame, artifact: str, kind: str, summary, ids: list[str], latest_wins: bool) -> tuple[DataFrame, DataFrame]:
    """(entities, raw snapshot rows). Snapshots merge by id, later values over earlier; event payloads either only
    fill what is missing, or take part as the latest."""
    snaps = ingest.snapshots(files, [artifact], ids=ids).cache()
    columns = [c for c in summary(F.col("record_json")) if c != "id"]
    rows = flat_entities(entity_records(files, snaps, kind), summary)
    if latest_wins:
        out = changes.merge_by_id(rows, columns, sighted=F.col("seq.k") == 0)
    else:
        later = rows.where("seq.k = 1").withColumn("seq", F.col("seq.n"))
        out = changes.fill_missing(changes.merge_by_id(rows.where("seq.k = 0"), columns), later, columns, source="source_file")
    return out.fillna("", ["first_seen_interval", "last_seen_interval"]), snaps


def few(values: DataFrame) -> list[str]:
    """The values of a column of texts, if there are no more than NEEDLES; else none."""
    found = [r[0] for r in values.limit(NEEDLES + 1).collect()]
    return found if len(found) <= NEEDLES else []


def merged_of(files: DataFrame, snaps: DataFrame, kind: str, summary, ids: DataFrame) -> DataFrame:
    """merged_entities(), the latest winning, of the entities of these ids(id) alone; no others are merged."""
    rec = F.col("record_json")
    columns = [c for c in summary(rec) if c != "id"]
    found = entity_records(files, snaps, kind, few(ids)).withColumn("known", records.members(rec))
    own = found.withColumn("id", summary(rec, F.col("known"))["id"]).join(ids, "id", "left_semi")
    out = changes.merge_by_id(flat_entities(own.drop("known", "id"), summary), columns, sighted=F.col("seq.k") == 0)
    return out.fillna("", ["first_seen_interval", "last_seen_interval"])


def linked_to(files: DataFrame, snaps: DataFrame, kind: str, summary, key: str, wanted: DataFrame) -> DataFrame:
    """Merged entities, the latest winning, whose key is among wanted(node). What an entity is merged to stands in one of its records, so those
    that name a wanted key tell which ids may be meant, and the records of these ids alone are merged."""
    nodes = wanted.select("node").distinct()
    naming = flat_entities(entity_records(files, snaps, kind, few(nodes)), summary, ["id", key])
    ids = graphs.cut(links.among(naming, key, nodes, "node").select("id").distinct())
    return links.among(merged_of(files, snaps, kind, summary, ids), key, nodes, "node")


def connected_part(edges: DataFrame, entities: DataFrame, seed: str, max_depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with depth, edges between them, nodes nothing was captured of)."""
    spark = edges.sparkSession
    edges = graphs.cut(edges)
    near = graphs.cut(graphs.hops_from(edges, spark.createDataFrame([(seed,)], "node string"), max_depth))
    part = graphs.cut(graphs.within(edges, near))
    return near, part, graphs.missing_nodes(part, entities)


def graph_rows(near: DataFrame, part: DataFrame, entities: DataFrame) -> DataFrame:
    ends = lambda key, other, name: part.groupBy(F.col(key).alias("id")).agg(F.array_join(F.sort_array(F.collect_set(other)), ",").alias(name))
    rows = links.looked_up(near.select(F.col("node").alias("id"), F.col("depth").alias("depth_from_seed")), entities, "id").join(ends("dst", "src", "predecessors"), "id", "left").join(ends("src", "dst", "successors"), "id", "left")
    rows = rows.withColumn("source_count", F.coalesce(F.size("sources"), F.lit(0)))
    return rows.orderBy(F.coalesce("create_time_utc", F.lit("")), "id")


def walked(part: DataFrame, seed: str) -> dict:
    successors = graphs.collect_subgraph(part) or {seed: []}
    heads = {d for s in successors.values() for d in s}
    return {
        "roots": [n for n in successors if n not in heads], "leaves": [n for n, s in successors.items() if not s], "branch_points": [n for n, s in successors.items() if len(s) > 1],
        "cycles": graphs.cycles(successors), "paths": graphs.root_paths(successors),
    }


def alloc_lineage(spark: SparkSession, root: str, alloc: str, output: str, max_depth: int = 50, overwrite: bool = False) -> Path:
    """Predecessors and successors of an allocation by the fields that name them."""
    need_uuid(alloc)
    root_p, _ = need_bundle(root)
    run = sinks.run_directory(Path(output) / alloc, overwrite)
    files = bundles.listing(spark, root, [output]).cache()
    entities, snaps = merged_entities(files, "allocations.json", "Allocation", records.allocation_summary, records.ALLOCATION_IDS, latest_wins=False)
    entities = entities.cache()
    near, part, missing = connected_part(graphs.allocation_edges(entities), entities, alloc, max_depth)
    rows = graph_rows(near, part, entities).cache()
    shown = rows.select(F.col("id").alias("allocation_id"), *["depth_from_seed", "job_id", "namespace", "task_group", "node_id", "node_name", "eval_id", "deployment_id", "desired_status", "client_status", "create_time_utc", "modify_time_utc", "predecessors", "successors", "first_seen_interval", "last_seen_interval", "source_count"])
    sinks.csv_file(shown, run / "lineage.csv")
    facts = walked(part, alloc)
    lacking = sorted(r["node"] for r in missing.collect())
    sinks.json_file(rows, run / "allocations.json")
    sinks.json_file({"edges": part.orderBy("src", "dst", "relation"), **facts}, run / "graph.json")
    known = entities.where(F.col("id") == alloc).count() > 0
    summary = {"seed": alloc, "seed_captured": known, "max_depth": max_depth, "allocations": rows.count(), "relationships": part.count(), "missing": lacking, **{k: len(v) for k, v in facts.items()}, **stats_of(snaps)}
    sinks.json_file(summary, run / "summary.json")
    sinks.markdown_file(run / "lineage.md", f"Lineage of allocation {alloc}", ("Summary", sinks.markdown_table(["what", "value"], summary.items())), ("Paths", "\n".join("- " + " -> ".join(p) for p in facts["paths"])), ("Relationships", part.orderBy("src", "dst", "relation")), ("Allocations", shown))
    for df in (files, snaps, entities, rows):
        df.unpersist()
    return run


def eval_trace(spark: SparkSession, root: str, output: str, evaluation: str | None = None, alloc: str | None = None, max_depth: int = 50, overwrite: bool = False) -> Path:
    """Evaluations linked to one (or to an allocation's), with the allocations they made."""
    if (evaluation is None) == (alloc is None):
        raise InputError("either an evaluation or an allocation is needed")
    root_p, _ = need_bundle(root)
    need_uuid(evaluation or alloc)
    run = sinks.run_directory(Path(output) / (evaluation or alloc), overwrite)
    files = bundles.listing(spark, root, [output]).cache()
    evals, snaps = merged_entities(files, "evaluations.json", "Evaluation", records.evaluation_summary, records.EVALUATION_IDS, latest_wins=True)
    evals, taken = evals.cache(), ingest.snapshots(files, ["allocations.json"], ids=records.ALLOCATION_IDS).cache()
    allocs = (files, taken, "Allocation", records.allocation_summary)
    seed = evaluation
    if alloc is not None:
        hit = merged_of(*allocs, spark.createDataFrame([(alloc,)], "id string")).select("eval_id").first()
        if hit is None or not hit["eval_id"]:
            raise SeedError(f"allocation {alloc} has no captured evaluation")
        seed = hit["eval_id"]
    near, part, missing = connected_part(graphs.evaluation_edges(evals), evals, seed, max_depth)
    related = linked_to(*allocs, "eval_id", near).cache()
    by_eval = links.ids_by(related, "eval_id", "id", "related_allocations").withColumnRenamed("eval_id", "id")
    rows = graph_rows(near, part, evals).join(by_eval, "id", "left").orderBy(F.coalesce("create_time_utc", F.lit("")), "id").cache()
    plain = ["depth_from_seed", "create_time_utc", "modify_time_utc", "namespace", "job_id", "node_id", "deployment_id", "triggered_by", "status", "status_description"]
    shown = rows.select(F.col("id").alias("evaluation_id"), *plain, F.col("predecessors").alias("previous_eval"), F.col("successors").alias("next_eval"), "blocked_eval", "related_allocations", "first_seen_interval", "last_seen_interval", "source_count")
    sinks.csv_file(shown, run / "eval_trace.csv")
    facts = walked(part, seed)
    sinks.json_file(rows, run / "evaluations.json")
    sinks.json_file(related.orderBy("id"), run / "allocations.json")
    sinks.json_file(part.orderBy("src", "dst", "relation"), run / "relationships.json")
    summary = {"seed": seed, "seed_captured": evals.where(F.col("id") == seed).count() > 0, "max_depth": max_depth, "evaluations": rows.count(), "relationships": part.count(), "related_allocations": related.count(), "missing": sorted(r["node"] for r in missing.collect()), **{k: len(v) for k, v in facts.items()}, **stats_of(snaps)}
    sinks.json_file(summary, run / "summary.json")
    sinks.markdown_file(run / "eval_trace.md", f"Trace of evaluation {seed}", ("Summary", sinks.markdown_table(["what", "value"], summary.items())), ("Paths", "\n".join("- " + " -> ".join(p) for p in facts["paths"])), ("Relationships", part.orderBy("src", "dst", "relation")), ("Evaluations", shown))
    for df in (files, snaps, evals, taken, related, rows):
        df.unpersist()
    return run


# 8 -----------------------------------------------------------------------------------------------
OBSERVATION = ["seed_type", "seed_value", "observation_state", "evidence_type", "source_artifact", "interval", "source_line", "matched_field", "matched_object_type", "matched_object_id"]


def captured_records(files: DataFrame, strict: bool = True, needles: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(records with their id fields, snapshot rows). needles: records that hold none of them need not be among the first. Neither is
    kept in memory: large snapshots lie in a checkpoint, the event stream is read where it stands."""
    rec, held = F.col("record_json"), ingest.may_hold(F.col("record_json"), list(needles))
    snaps = ingest.snapshots(files, list(ingest.WRAPPERS), numbered=False)
    kinds = {"Allocation": "allocations.json", "Evaluation": "evaluations.json", "Job": "jobs.json", "Node": "nodes.json", "Deployment": "deployments.json"}
    stream = stream_rows(files, list(needles)).where(held).withColumn("inner", records.members(records.get(rec, "Payload")))
    inner = F.array(*[F.struct(F.lit(a).alias("artifact"), F.col("inner")[k].alias("record_json")) for k, a in kinds.items()])
    payloads = stream.select("rel", "line_no", F.explode(F.filter(inner, lambda x: x["record_json"].startswith("{"))).alias("x"))
    rows = snaps.where("record_json is not null").where(held).select(F.lit("interval_snapshot").alias("evidence_type"), F.col("rel").alias("source_artifact"), F.col("interval_id").alias("interval"), F.lit("").alias("source_line"), "artifact", rec.alias("record_json"))
    rows = rows.unionByName(payloads.select(F.lit("eventstream_payload").alias("evidence_type"), F.col("rel").alias("source_artifact"), F.lit("").alias("interval"), F.col("line_no").cast("string").alias("source_line"), "x.artifact", "x.record_json"))
    fields = records.seed_fields(rec, F.col("artifact"), strict, F.col("known"))
    out = rows.withColumn("known", records.members(rec)).withColumn("fields", fields).withColumn("matched_object_type", F.regexp_replace("artifact", r"\.json$", "")).withColumn("matched_object_id", F.coalesce(F.try_element_at("fields", F.lit(1))["value"], F.lit("")))
    return out.drop("artifact", "record_json", "known"), snaps


def case_review(spark: SparkSession, root: str, case_context: str, output: str, overwrite: bool = False, strict: bool = True) -> Path:
    """A case's reported identifiers against what was captured. Claims stay unassessed: a sighting proves none."""
    root_p, bundle = need_bundle(root)
    try:
        context = bundles.load_context(case_context)
    except bundles.ContextError as e:
        raise InputError(str(e)) from e
    run = sinks.run_directory(Path(output) / text.slug(context.get("case_reference") or "", otherwise="case-review"), overwrite)
    files = bundles.listing(spark, root, [output]).cache()
    seeds = bundles.seeds_of(spark, context)
    wanted = seeds.count()
    recs, snaps = captured_records(files, strict, few(seeds.select("seed_value").distinct()))
    seen = graphs.cut(review.observations(recs, F.broadcast(seeds) if wanted <= splits.BROADCAST_ROWS else seeds).withColumn("matched_field", F.col("seed_type")))
    rows = review.with_not_observed(seen, seeds).fillna("", OBSERVATION).select(*OBSERVATION)
    rows = ordinals.fixed_order(rows, [*OBSERVATION[:3], "source_artifact", "interval", "source_line", *OBSERVATION[-2:], "evidence_type"])  # many share a file, so their ids part them
    sinks.csv_file(rows, run / "report.csv")
    claims = [{"id": c["id"], "claim": c["claim"], "source": c.get("source", "case context"), "assessment": "not assessed: identifiers alone confirm no claim", "evidence_needed": c.get("evidence_needed", [])} for c in context.get("claims_to_test", [])]
    parsing = {"intervals": len(bundles.interval_ids(bundle)), **stats_of(snaps), "eventstream_records": stream_rows(files).count()}
    sinks.json_file({"case_context_path": str(case_context), "case_context": context, "seed_observations": rows, "claim_assessments": claims, "parsing": parsing}, run / "supporting.json")
    counts = {r["observation_state"]: r["seeds"] for r in review.seed_counts(rows).collect()}
    summary = {"case_reference": context.get("case_reference", ""), "classification": context["classification"], "seed_count": wanted, "observed_seed_count": counts.get("observed", 0), "not_observed_seed_count": counts.get(review.NOT_OBSERVED, 0), "claim_count": len(claims), "claim_confirmation_count": 0, "parsing": parsing}
    sinks.json_file(summary, run / "summary.json")
    sinks.markdown_file(run / "report.md", "Case review", ("Scope", "What the case reports is a lead, not evidence; not observed does not mean absent."), ("Identifiers", rows), ("Claims", sinks.markdown_table(["id", "claim", "source", "assessment", "evidence needed"], ((c["id"], c["claim"], c["source"], c["assessment"], "; ".join(map(str, c["evidence_needed"]))) for c in claims))), ("Parsing", sinks.markdown_table(["what", "value"], parsing.items())))
    files.unpersist()
    return run


# 9 -----------------------------------------------------------------------------------------------
CASE_NUMBER = re.compile(r"\bTS\d{9}\b", re.IGNORECASE)


def case_intake(spark: SparkSession, case_root: str, output: str, bundle: str | None = None, case_context: str | None = None, max_depth: int = 14, overwrite: bool = False) -> Path:
    """Which bundle a case directory holds, and what lies beside it. Several bundles and no choice: refused."""
    root = Path(case_root)
    if not root.is_dir():
        raise InputError(f"{case_root} is no directory")
    found, unread = bundles.discover(root, output, max_depth)
    if bundle is not None:
        found = [c for c in found if Path(c.path).resolve() == Path(bundle).resolve()]
    if len(found) != 1:
        listed = sinks.first_of([f"{c.path} (intervals={c.interval_count}, servers={c.server_count}, clients={c.client_count})" for c in found], 12, "candidates")
        raise InputError(f"one bundle is needed, found {len(found)}" + (f":\n{listed}" if found else ""))
    m = CASE_NUMBER.search(str(root.resolve()))
    reference = m.group(0).upper() if m else root.resolve().name
    run = sinks.run_directory(Path(output) / text.slug(reference, otherwise="case-intake"), overwrite)
    chosen = found[0]
    artifacts = bundles.case_artifacts(spark, root, [chosen.path, output], max_depth).orderBy("path").cache()
    n = sinks.csv_file(artifacts, run / "artifacts.csv")
    kinds = artifacts.groupBy("category").count().orderBy("category").collect()
    summary = {"case_root": str(root), "case_reference": reference, "case_context_path": case_context or "", "bundle_candidates": bundles.candidate_rows(found), "selected_bundle": bundles.candidate_rows(found)[0], "adjacent_artifact_count": n, "artifact_category_counts": {r[0]: r[1] for r in kinds}, "discovery_inaccessible_paths": unread}
    sinks.json_file(summary, run / "summary.json")
    steps = [f"python -m strataprobe inventory '{chosen.path}' --output '{run}/inventory'"]
    steps += [f"python -m strataprobe review '{chosen.path}' --case-context '{case_context}' --output '{run}/review'"] if case_context else []
    sinks.markdown_file(run / "next_steps.md", "Next steps", ("Commands", "```bash\n" + "\n".join(steps) + "\n```"))
    sinks.markdown_file(run / "report.md", "Case intake", ("Case", f"{reference} at `{root}`; names and sizes only, nothing was opened."), ("Bundles", sinks.markdown_table(list(summary["selected_bundle"]), (list(c.values()) for c in summary["bundle_candidates"]))), ("Beside it", sinks.markdown_table(["category", "files"], ((r[0], r[1]) for r in kinds))))
    artifacts.unpersist()
    return run
