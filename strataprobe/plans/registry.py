"""The operators as named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, timestamps
from ..operators import changes, graphs, inventory, links, review, search, timeline, windows
from ..sources import tables
from ..sources.tables import document_lines, event_timeline, events, table

START, END = datetime(2024, 1, 10, tzinfo=UTC), datetime(2024, 1, 12, tzinfo=UTC)
IDS = ["the and", "tion", "zzz-none"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({0}) % 1000000 = 0 THEN '' ELSE '.' || lpad((microsecond({0}) % 1000000)::VARCHAR, 6, '0') END || 'Z'"
REL = "CASE WHEN regexp_matches(lower({0}), 'planresult|evaluationupdated|jobregistered|allocationupdated|nodedrain|drain|migrate|resched|restart|health|failed|lost|blocked') THEN 'high' WHEN regexp_matches(lower({0}), 'allocation observed|evaluation observed|node observed|template render|scheduler') THEN 'medium' WHEN {1} LIKE '%\\_monitor\\_log' ESCAPE '\\' THEN 'telemetry' ELSE 'medium' END"
LINES = "SELECT doc_id::VARCHAR AS path, unnest(range(1, len(ls) + 1))::INT AS line_no, unnest(ls) AS line FROM (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS ls FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\n|\\r') AS l FROM documents))"
RULES = [("task not restarting", "not restarting"), ("task restart signaled", "restart signaled"), ("task restarting", "restarting"), ("disk migration", "migrate_disk|migrating data|snapshot from previous alloc"), ("health check", "healthcheck|health check|check_restart"), ("task killing", "task killing| killing"), ("task terminated", "terminated"), ("task started", "task started| started"), ("node drain", "drain"), ("allocation reschedule", "reschedul"), ("allocation migration", "migrat"), ("template render", "template-render|rendering"), ("allocation log record", "alloc")]


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def iso(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, timestamps.iso_utc(F.col(c)))
    return df


# timelines ---------------------------------------------------------------------------------------
@query(
    "timeline_correlated",
    f"""
WITH e AS (
  SELECT ts, 'eventstream' AS source_type, 'events' AS source_file, event_id::INT AS source_line, 'user' AS object_type, user_id::VARCHAR AS object_id,
    CASE WHEN event_type = 'error' THEN 'event failed' ELSE event_type END AS event, 'props=' || props AS details FROM events
  UNION ALL SELECT o_orderdate, 'interval_snapshot', 'orders', o_orderkey::INT, 'order', o_orderkey::VARCHAR, 'order observed', 'status=' || o_orderstatus || '; priority=' || o_orderpriority FROM orders
  UNION ALL SELECT l_shipdate, 'server_monitor_log', 'lineitem', l_linenumber::INT, 'shipment', l_orderkey::VARCHAR, 'shipped', 'flag=' || l_returnflag || '; status=' || l_linestatus || '; part=' || l_partkey::VARCHAR FROM lineitem)
SELECT {ISO.format('ts')} AS ts, source_type, source_file, source_line, object_type, object_id, event, details, {REL.format("event || ' ' || details", 'source_type')} AS relevance
FROM e WHERE (ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' OR ts BETWEEN TIMESTAMP '1998-03-01' AND TIMESTAMP '1998-03-08')
  AND (contains(details, '"k": 1') OR contains(details, 'priority=1') OR contains(details, 'flag=R'))""",
)
def timeline_correlated(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        tables.utc(F.col("o_orderdate")).alias("ts"), F.lit("interval_snapshot").alias("source_type"), F.lit("orders").alias("source_file"), F.col("o_orderkey").cast("int").alias("source_line"),
        F.lit("order").alias("object_type"), F.col("o_orderkey").cast("string").alias("object_id"), F.lit("order observed").alias("event"),
        F.concat(F.lit("status="), "o_orderstatus", F.lit("; priority="), "o_orderpriority").alias("details"), F.lit("").alias("source_group"),
    )
    shipped = table(spark, sf_dir, "lineitem").select(
        tables.utc(F.col("l_shipdate")).alias("ts"), F.lit("server_monitor_log").alias("source_type"), F.lit("lineitem").alias("source_file"), F.col("l_linenumber").cast("int").alias("source_line"),
        F.lit("shipment").alias("object_type"), F.col("l_orderkey").cast("string").alias("object_id"), F.lit("shipped").alias("event"),
        F.concat(F.lit("flag="), "l_returnflag", F.lit("; status="), "l_linestatus", F.lit("; part="), F.col("l_partkey").cast("string")).alias("details"), F.lit("").alias("source_group"),
    )
    inside = timestamps.in_window(F.col("ts"), START, END) | timestamps.in_window(F.col("ts"), datetime(1998, 3, 1, tzinfo=UTC), datetime(1998, 3, 8, tzinfo=UTC))
    parts = [timeline.with_relevance(p.where(inside & timeline.holds_any(F.col("details"), ['"k": 1', "priority=1", "flag=R"]))) for p in (event_timeline(spark, sf_dir), orders, shipped)]
    return iso(timeline.ordered(timeline.merged(*parts)).drop("source_group"), "ts")


@query("timeline_window", f"SELECT event_id, {ISO.format('ts')} AS ts, user_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'")
def timeline_window(spark, sf_dir):
    return iso(events(spark, sf_dir).where(timestamps.in_window(F.col("ts"), START, END)).select("event_id", "ts", "user_id", "event_type"), "ts")


@query("timeline_or_filters", """SELECT event_id, event_type, user_id FROM events WHERE contains(props, '"k": 7') OR event_type = 'signup' OR user_id = 8""")
def timeline_or_filters(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.where(timeline.holds_any(F.col("props"), ['"k": 7']) | (F.col("event_type") == "signup") | (F.col("user_id") == 8)).select("event_id", "event_type", "user_id")


@query("timeline_relevance_counts", f"SELECT relevance, count(*) AS n FROM (SELECT {REL.format("CASE WHEN event_type = 'error' THEN 'event failed' ELSE event_type END || ' props=' || props", "'eventstream'")} AS relevance FROM events) GROUP BY 1")
def timeline_relevance_counts(spark, sf_dir):
    return timeline.with_relevance(event_timeline(spark, sf_dir)).groupBy("relevance").agg(F.count("*").alias("n"))


@query(
    "timeline_dedupe",
    """
SELECT strftime(m, '%Y-%m-%dT%H:%M:%SZ') AS ts, event_type AS message, n, CASE WHEN n > 1 THEN 'correlated_monitor_log' ELSE side || '_monitor_log' END AS source_type, sides AS source_group, paths AS source_file,
  CASE WHEN n = 1 THEN line_no END AS source_line
FROM (SELECT date_trunc('minute', ts) AS m, event_type, count(*) AS n, min(CASE WHEN user_id % 2 = 0 THEN 'server' ELSE 'client' END) AS side,
  string_agg(DISTINCT CASE WHEN user_id % 2 = 0 THEN 'server' ELSE 'client' END, ',' ORDER BY CASE WHEN user_id % 2 = 0 THEN 'server' ELSE 'client' END) AS sides,
  string_agg(DISTINCT user_id::VARCHAR, ' + ' ORDER BY user_id::VARCHAR) AS paths, min(event_id)::INT AS line_no FROM events GROUP BY 1, 2)""",
)
def timeline_dedupe(spark, sf_dir):
    e = events(spark, sf_dir)
    side = F.when(F.col("user_id") % 2 == 0, "server").otherwise("client")
    hits = e.select(F.date_trunc("minute", "ts").alias("ts"), F.col("user_id").cast("string").alias("path"), side.alias("side"), F.col("event_id").cast("int").alias("line_no"), F.col("event_type").alias("line"))
    found = timeline.correlated_log_events(hits, [], keep=("message", "n"))
    return iso(found.select("ts", "message", "n", "source_type", "source_group", "source_file", "source_line"), "ts")


@query("timeline_topn", f"SELECT {ISO.format('ts')} AS ts, event_id FROM events ORDER BY events.ts, event_id LIMIT 500")
def timeline_topn(spark, sf_dir):
    e = event_timeline(spark, sf_dir).withColumn("source_file", F.lpad(F.col("source_line").cast("string"), 12, "0"))
    return iso(timeline.earliest(e, 500).select("ts", F.col("source_line").cast("long").alias("event_id")), "ts")


# logs --------------------------------------------------------------------------------------------
@query("log_suppression", f"SELECT count(*) FILTER (WHERE noise) AS suppressed, count(*) FILTER (WHERE NOT noise) AS kept FROM (SELECT contains(l, '/v1/agent/pprof/') OR contains(l, '/v1/agent/host') OR contains(l, 's.rpcHandlerForNode()') AS noise FROM (SELECT CASE WHEN line_no % 7 = 0 THEN 'GET /v1/agent/host ' ELSE '' END || line AS l FROM ({LINES})))")
def log_suppression(spark, sf_dir):
    lines = document_lines(spark, sf_dir).withColumn("line", F.concat(F.when(F.col("line_no") % 7 == 0, "GET /v1/agent/host ").otherwise(""), "line"))
    noise = classify.is_debug_traffic(F.col("line"))
    return lines.agg(F.count_if(noise).alias("suppressed"), F.count_if(~noise).alias("kept"))


LOG_WORDS = ["task restarting", "snapshot from previous alloc", "health check", "reschedule", "allocation", "draining", "plain"]


@query(
    "log_classify_counts",
    "SELECT event, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(l), '{p}') THEN '{n}'" for n, p in RULES) + f" ELSE 'matching log record' END AS event FROM (SELECT {LOG_WORDS!r}[line_no % 7 + 1] || ' ' || line AS l FROM ({LINES}))) GROUP BY 1",
)
def log_classify_counts(spark, sf_dir):
    word = F.element_at(F.array(*[F.lit(w) for w in LOG_WORDS]), F.col("line_no") % 7 + 1)
    lines = document_lines(spark, sf_dir).select(classify.history_event(F.concat_ws(" ", word, "line")).alias("event"))
    return lines.groupBy("event").agg(F.count("*").alias("n"))


# search ------------------------------------------------------------------------------------------
MATCH = "SELECT i AS identifier, path, line_no, line, (length({1}) - length(replace({1}, {0}, ''))) // length({0}) AS occ FROM ({2}) l, (SELECT unnest({3!r}) AS i) WHERE contains({1}, {0})"
PLAIN = MATCH.format("i", "line", LINES, IDS)


@query("find_matches", f"SELECT identifier, path, sum(occ)::BIGINT AS match_count, count(*) AS matching_lines, min(line_no) AS first_line, max(line_no) AS last_line FROM ({PLAIN}) GROUP BY 1, 2")
def find_matches(spark, sf_dir):
    return search.match_counts(search.line_matches(document_lines(spark, sf_dir), IDS))


@query("find_totals", f"SELECT identifier, d.source AS category, sum(occ)::BIGINT AS occurrences, count(DISTINCT path) AS files FROM ({PLAIN}) m JOIN documents d ON d.doc_id::VARCHAR = m.path GROUP BY 1, 2")
def find_totals(spark, sf_dir):
    # the category rides along with the text, so that counting needs no join
    docs = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("\u0001", F.col("doc_id").cast("string"), "source"))
    counts = search.match_counts(search.line_matches(search.numbered_lines(docs, "path", "text"), IDS))
    return search.match_totals(counts.withColumn("category", F.split("path", "\u0001")[1]))


@query(
    "find_samples",
    f"""WITH m AS ({PLAIN}), s AS (SELECT *, row_number() OVER (PARTITION BY identifier, path ORDER BY line_no)::INT AS sample_no FROM m),
p AS (SELECT *, length(line) AS n, strpos(line, identifier) - 1 AS spot, greatest(1, (60 - length(identifier)) // 2) AS half FROM s WHERE sample_no <= 3),
a AS (SELECT *, greatest(0, spot - half) AS b, least(n, spot + length(identifier) + half) AS e FROM p),
c AS (SELECT *, CASE WHEN b > 0 AND e = n THEN greatest(0, b - greatest(0, 60 - (e - b))) ELSE b END AS b2, CASE WHEN b = 0 THEN least(n, e + greatest(0, 60 - (e - b))) ELSE e END AS e2 FROM a)
SELECT identifier, path, line_no, sample_no, CASE WHEN n <= 60 THEN line ELSE CASE WHEN b2 > 0 THEN '… ' ELSE '' END || substr(line, b2 + 1, e2 - b2) || CASE WHEN e2 < n THEN ' …[truncated]' ELSE '' END END AS excerpt FROM c""",
)
def find_samples(spark, sf_dir):
    return search.match_samples(search.line_matches(document_lines(spark, sf_dir), IDS), 3, 60)


@query("find_ignore_case", f"SELECT identifier, path, sum(occ)::BIGINT AS match_count, count(*) AS matching_lines, min(line_no) AS first_line, max(line_no) AS last_line FROM ({MATCH.format('lower(i)', 'lower(line)', LINES, ['THE and', 'Tion'])}) GROUP BY 1, 2")
def find_ignore_case(spark, sf_dir):
    return search.match_counts(search.line_matches(document_lines(spark, sf_dir), ["THE and", "Tion"], ignore_case=True))


@query("line_numbers", f"SELECT path, line_no, line FROM ({LINES})")
def line_numbers(spark, sf_dir):
    return document_lines(spark, sf_dir)


PATHS = ["cluster/eventstream.json", "interval/0001/allocations.json", "interval/0001/nodes.json", "x/metrics/a.log", "server/a/monitor.log", "server/b/agent.log", "x/client/c/syslog", "notes.txt"]
PATH_SQL = f"SELECT page_id, {PATHS!r}[page_id % 8 + 1] AS path FROM pages"
CATEGORY = "CASE WHEN name = 'eventstream.json' THEN 'event_stream' WHEN name = 'allocations.json' THEN 'allocation_snapshot' WHEN name = 'nodes.json' THEN 'node_snapshot' WHEN contains(path, '/metrics/') THEN 'metrics' WHEN name = 'monitor.log' THEN 'monitor_log' WHEN contains('/' || path, '/server/') THEN 'server_log' WHEN contains('/' || path, '/client/') THEN 'client_log' ELSE 'other' END"


def page_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.element_at(F.array(*[F.lit(p) for p in PATHS]), (F.col("page_id") % 8 + 1).cast("int")).alias("path"))


@query("category_rank", f"SELECT page_id, category, CASE category WHEN 'event_stream' THEN 10 WHEN 'allocation_snapshot' THEN 20 WHEN 'node_snapshot' THEN 60 WHEN 'monitor_log' THEN 80 WHEN 'server_log' THEN 90 WHEN 'client_log' THEN 100 WHEN 'metrics' THEN 500 ELSE 900 END AS rank FROM (SELECT *, {CATEGORY} AS category FROM (SELECT *, string_split(path, '/')[-1] AS name FROM ({PATH_SQL})))")
def category_rank(spark, sf_dir):
    out = page_paths(spark, sf_dir).withColumn("category", classify.path_category(F.col("path")))
    return out.select("page_id", "category", classify.category_rank(F.col("category")).alias("rank"))


# inventory ---------------------------------------------------------------------------------------
def document_files(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".log", ".tar.gz", "", ".bin")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("server/"), "source", F.lit("/monitor"), ext).alias("path"), F.octet_length("text").cast("long").alias("length"), F.sha2("text", 256).alias("sha256")
    )


FILES = "SELECT doc_id, 'server/' || source || '/monitor' || ['.log', '.tar.gz', '', '.bin'][doc_id % 4 + 1] AS path, strlen(text) AS length, sha256(text) AS sha256 FROM documents"


@query(
    "file_inventory",
    f"""SELECT path, length AS size_bytes, CASE WHEN length < 1024 THEN printf('%.1f B', length::DOUBLE) WHEN length < 1048576 THEN printf('%.1f KB', length / 1024.0::DOUBLE) ELSE printf('%.1f MB', length / 1048576.0::DOUBLE) END AS size_human,
  ['.log', '.gz', '(none)', '.bin'][doc_id % 4 + 1] AS extension, ['text', 'archive', 'binary_or_unknown', 'binary_or_unknown'][doc_id % 4 + 1] AS kind, CASE WHEN doc_id % 4 = 0 THEN 'nomad_server_log,nomad_client_log' ELSE 'nomad_server_log' END AS likely_role, sha256 FROM ({FILES})""",
)
def file_inventory(spark, sf_dir):
    return inventory.file_rows(document_files(spark, sf_dir))


@query("role_labels", f"SELECT role, count(*) AS files FROM (SELECT unnest(CASE WHEN path LIKE '%eventstream%' THEN ['event_stream'] WHEN path LIKE '%allocations%' THEN ['allocation'] WHEN path LIKE '%nodes%' THEN ['node'] WHEN path LIKE '%metrics%' THEN ['metrics'] WHEN path LIKE '%monitor%' THEN ['nomad_server_log', 'nomad_client_log'] WHEN path LIKE 'server%' THEN ['nomad_server_log'] WHEN path LIKE '%client%' THEN ['nomad_client_log'] ELSE ['unknown'] END) AS role FROM ({PATH_SQL})) GROUP BY 1")
def role_labels(spark, sf_dir):
    return inventory.role_counts(page_paths(spark, sf_dir).withColumn("likely_role", classify.file_roles(F.col("path"))))


@query("largest_files", "SELECT doc_id::VARCHAR AS path, n_chars AS size_bytes FROM documents ORDER BY n_chars DESC, doc_id::VARCHAR LIMIT 25")
def largest_files(spark, sf_dir):
    return inventory.largest(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size_bytes")))


@query("inventory_totals", f"SELECT count(*) AS files, sum(length)::BIGINT AS bytes, count(*) FILTER (WHERE doc_id % 4 = 0) AS text_files FROM ({FILES})")
def inventory_totals(spark, sf_dir):
    return inventory.totals(inventory.file_rows(document_files(spark, sf_dir)))


@query("coverage_presence", "SELECT event_type, count(DISTINCT ts::DATE) AS present_in FROM events GROUP BY 1")
def coverage_presence(spark, sf_dir):
    return inventory.presence(events(spark, sf_dir).withColumn("day", F.to_date(F.to_utc_timestamp("ts", F.current_timezone()))), "event_type", "day")


DAYS = "SELECT DISTINCT user_id, (ts::DATE - DATE '2024-01-01')::BIGINT AS day FROM events"


@query("coverage_gaps", f"WITH d AS ({DAYS}), b AS (SELECT user_id, min(day) AS a, max(day) AS z FROM d GROUP BY 1) SELECT user_id, g AS missing FROM (SELECT user_id, unnest(range(a, z + 1)) AS g FROM b) WHERE (user_id, g) NOT IN (SELECT (user_id, day) FROM d)")
def coverage_gaps(spark, sf_dir):
    day = F.floor(F.unix_seconds("ts") / 86400) - 19723
    return inventory.gaps(events(spark, sf_dir).select("user_id", day.alias("day")), ["user_id"], "day")


@query("coverage_padded_gaps", f"WITH d AS ({DAYS}), b AS (SELECT user_id, min(day) AS a, max(day) AS z FROM d GROUP BY 1) SELECT user_id, lpad(g::VARCHAR, 4, '0') AS missing FROM (SELECT user_id, unnest(range(a, z + 1)) AS g FROM b) WHERE (user_id, g) NOT IN (SELECT (user_id, day) FROM d)")
def coverage_padded_gaps(spark, sf_dir):
    day = (F.floor(F.unix_seconds("ts") / 86400) - 19723).cast("string")
    return inventory.padded_gaps(events(spark, sf_dir).select("user_id", F.lpad(day, 4, "0").alias("name")).distinct(), ["user_id"], "name")


STAMPED = "SELECT user_id::VARCHAR AS path, event_id::INT AS line_no, ts"


@query("time_bounds", f"SELECT user_id::VARCHAR AS path, count(*) AS line_count, {ISO.format('min(ts)')} AS first_ts, {ISO.format('max(ts)')} AS last_ts FROM events GROUP BY 1")
def time_bounds(spark, sf_dir):
    e = events(spark, sf_dir)
    line = F.concat(F.lit("at "), timestamps.iso_utc(F.col("ts")), F.lit(" "), "event_type")
    return iso(inventory.time_bounds(e.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("line_no"), line.alias("line"))), "first_ts", "last_ts")


@query(
    "timestamp_forms",
    f"""SELECT event_id, {ISO.format('ts')} AS t1, {ISO.format("ts + INTERVAL 7 HOUR")} AS t2, {ISO.format("date_trunc('second', ts) - INTERVAL 330 MINUTE")} AS t3, 3::INT AS n FROM events""",
)
def timestamp_forms(spark, sf_dir):
    wall = lambda f: F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), f)
    line = F.concat(
        wall("yyyy-MM-dd HH:mm:ss"), F.lit(" +0530 UTC then "), wall("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("-0700, "), wall("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z; bad 2024-13-45T00:00:00Z")
    )
    t = F.col("t")
    out = events(spark, sf_dir).select("event_id", timestamps.timestamps_in(line).alias("t"))
    return out.select("event_id", *[timestamps.iso_utc(F.get(t, i)).alias(f"t{i + 1}") for i in range(3)], F.size("t").alias("n"))


@query(
    "epoch_decode",
    """SELECT event_id, s AS s, s AS ms, s AS us, 'null' AS zero FROM (SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS s FROM events)""",
)
def epoch_decode(spark, sf_dir):
    e = events(spark, sf_dir)
    sec = F.unix_seconds("ts")
    read = lambda c: timestamps.iso_utc(timestamps.epoch_to_timestamp(c))
    return e.select("event_id", read(sec).alias("s"), read(sec * 1000).alias("ms"), read(sec * 1_000_000).alias("us"), F.when(timestamps.epoch_to_timestamp(F.lit(0)).isNull(), "null").otherwise("set").alias("zero"))


# histories ---------------------------------------------------------------------------------------
REPR = "CASE WHEN {0} IS NULL THEN 'None' ELSE '''' || {0}::VARCHAR || '''' END"
LAGGED = "SELECT *, lag({0}) OVER w AS p_{0}, row_number() OVER w AS rn"


@query(
    "snapshot_diff",
    """SELECT event_id, user_id, rn = 1 AS first, CASE WHEN rn = 1 THEN '' ELSE concat_ws('; ', CASE WHEN p_event_type IS DISTINCT FROM event_type THEN 'type: ''' || p_event_type || ''' -> ''' || event_type || '''' END,
  CASE WHEN p_bucket IS DISTINCT FROM bucket THEN 'bucket: ''' || p_bucket || ''' -> ''' || bucket || '''' END) END AS changes
FROM (SELECT *, lag(event_type) OVER w AS p_event_type, lag(bucket) OVER w AS p_bucket, row_number() OVER w AS rn FROM (SELECT event_id, user_id, event_type, ts, floor(value / 10)::INT::VARCHAR AS bucket FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
)
def snapshot_diff(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("bucket", F.floor(F.col("value") / 10).cast("int").cast("string"))
    return changes.differences(e, ["user_id"], ["ts", "event_id"], {"event_type": "type", "bucket": "bucket"}).select("event_id", "user_id", "first", "changes")


@query(
    "snapshot_collapse",
    f"""SELECT user_id, event_type, count(*) AS n, {ISO.format('min(ts)')} AS first_ts, {ISO.format('max(ts)')} AS last_ts FROM (
  SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (
    SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS step FROM events)) GROUP BY user_id, island, event_type""",
)
def snapshot_collapse(spark, sf_dir):
    runs = timeline.collapsed(events(spark, sf_dir), ["ts", "event_id"], F.col("event_type"), partition=["user_id"])
    return iso(runs.groupBy("user_id", "island", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("island"), "first_ts", "last_ts")


@query(
    "merge_latest",
    """SELECT user_id AS id, arg_max(event_type, event_id) AS event_type, arg_max(kind, event_id) FILTER (WHERE kind <> '') AS kind, arg_min(day, event_id) AS first_seen_interval, arg_max(day, event_id) AS last_seen_interval,
  list_aggregate(list_distinct_ordered, 'string_agg', ',') AS sources FROM (SELECT *, strftime(ts, '%Y%m%d') AS day, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS kind,
  NULL AS x FROM events) JOIN (SELECT user_id, list(event_type ORDER BY f) AS list_distinct_ordered FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) GROUP BY 1) USING (user_id) GROUP BY user_id, list_distinct_ordered""",
)
def merge_latest(spark, sf_dir):
    e = events(spark, sf_dir)
    rows = e.select(
        F.col("user_id").alias("id"), "event_type", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("kind"), F.col("event_id").alias("seq"),
        F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyyMMdd").alias("interval_id"), F.col("event_type").alias("source_file"),
    )
    out = changes.merge_by_id(rows, ["event_type", "kind"])
    return out.withColumn("sources", F.array_join("sources", ","))


@query(
    "merge_fill_missing",
    """WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer),
e AS (SELECT user_id AS id, arg_min(event_type, event_id) AS name, arg_min(kind, event_id) FILTER (WHERE kind <> '') AS segment FROM (SELECT *, CASE WHEN event_type = 'error' THEN '' ELSE 'seg-' || event_type END AS kind FROM events) GROUP BY 1)
SELECT id, coalesce(nullif(c.name, ''), e.name, c.name) AS name, coalesce(nullif(c.segment, ''), e.segment, c.segment) AS segment FROM c FULL JOIN e USING (id)""",
)
def merge_fill_missing(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 2 != 0, F.col("c_mktsegment")).alias("segment"))
    e = events(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("seg-"), "event_type")).alias("segment"))
    return changes.fill_missing(c, e, ["name", "segment"])


# graphs ------------------------------------------------------------------------------------------
TURNS = "SELECT conv_id, turn, conv_id || '-' || turn AS node FROM conversations"
EDGES = f"SELECT DISTINCT a.node AS src, b.node AS dst, 'next' AS relation FROM ({TURNS}) a JOIN ({TURNS}) b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


def turn_edges(spark, sf_dir):
    """Each turn's link to the next (from the earlier turn's side) and to the one before (from the later's):
    the same edges seen twice, so deduped."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    node = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    near = c.withColumn("up", F.lead("turn").over(w)).withColumn("down", F.lag("turn").over(w))
    ahead = near.where(F.col("up") == F.col("turn") + 1).select(node(F.col("turn")).alias("src"), node(F.col("up")).alias("dst"), F.lit("next").alias("relation"), F.lit(1).alias("side"))
    back = near.where(F.col("down") == F.col("turn") - 1).select(node(F.col("down")).alias("src"), node(F.col("turn")).alias("dst"), F.lit("next").alias("relation"), F.lit(2).alias("side"))
    return graphs.edge_set(ahead.unionByName(back), ["side"]).select("src", "dst", "relation")


@query("edges_build", EDGES)
def edges_build(spark, sf_dir):
    return turn_edges(spark, sf_dir)


@query("bfs_depth", f"WITH RECURSIVE e AS (SELECT src, dst FROM ({EDGES}) UNION SELECT dst, src FROM ({EDGES})), r(node, depth) AS (SELECT '5-1', 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 12) SELECT node, min(depth)::INT AS depth FROM r GROUP BY 1")
def bfs_depth(spark, sf_dir):
    return graphs.hops_from(turn_edges(spark, sf_dir), spark.createDataFrame([("5-1",)], "node string"), 12)


@query("graph_degree", f"WITH e AS ({EDGES}), n AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) SELECT node, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out, CASE WHEN sum(o) > 1 THEN 'branch' WHEN sum(i) = 0 THEN 'root' WHEN sum(o) = 0 THEN 'leaf' ELSE 'through' END AS kind FROM n GROUP BY 1")
def graph_degree(spark, sf_dir):
    return graphs.degrees(turn_edges(spark, sf_dir))


@query("graph_missing", f"WITH e AS ({EDGES}), ends AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node FROM ends WHERE node NOT IN (SELECT node FROM ({TURNS}) WHERE turn % 5 <> 4)")
def graph_missing(spark, sf_dir):
    known = table(spark, sf_dir, "conversations").where(F.col("turn") % 5 != 4).select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"))
    return graphs.missing_nodes(turn_edges(spark, sf_dir), known)


@query("graph_within", f"WITH e AS ({EDGES}), n AS (SELECT node FROM ({TURNS}) WHERE turn % 3 <> 2) SELECT * FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)")
def graph_within(spark, sf_dir):
    n = table(spark, sf_dir, "conversations").where(F.col("turn") % 3 != 2).select(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("node"))
    return graphs.within(turn_edges(spark, sf_dir), n)


CHAINS = f"SELECT *, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS chain FROM ({TURNS})"


@query("graph_paths", f"SELECT string_agg(node, '>' ORDER BY turn) AS path FROM ({CHAINS}) GROUP BY conv_id, chain")
def graph_paths(spark, sf_dir):
    """Every chain of turns of every conversation."""
    node = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("node")
    paths = graphs.all_root_paths(turn_edges(spark, sf_dir), table(spark, sf_dir, "conversations").select(node))
    return paths.select(F.array_join("nodes", ">").alias("path"))


@query(
    "graph_cycles",
    f"""WITH g AS (SELECT conv_id, list(node ORDER BY turn) AS l, min(node) AS least, min(turn) AS a, max(turn) AS z FROM ({CHAINS}) GROUP BY conv_id, chain HAVING count(*) > 1),
c AS (SELECT *, list_position(l, least) AS p FROM g WHERE conv_id IN (SELECT conv_id FROM g GROUP BY conv_id HAVING count(*) = 1))
SELECT array_to_string(l[p:] || l[:p - 1] || [least], '>') AS path FROM c""",
)
def graph_cycles(spark, sf_dir):
    """The turns of every conversation, its last linked turn closed to its first: one cycle a conversation, unless turns
    are missing in between."""
    part = turn_edges(spark, sf_dir).select("src", "dst")
    turn = lambda c: F.split(c, "-")[1].cast("long")
    ends = part.groupBy(F.split("src", "-")[0]).agg(F.max_by("dst", turn("dst")).alias("src"), F.min_by("src", turn("src")).alias("dst"))
    return graphs.all_cycles(part.union(ends.select("src", "dst"))).select(F.array_join("nodes", ">").alias("path"))


# association and review --------------------------------------------------------------------------
@query("assoc_semi", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def assoc_semi(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return links.among(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", urgent, "o_orderkey")


@query("assoc_group", "SELECT o_orderkey, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR), '') AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def assoc_group(spark, sf_dir):
    parts = links.ids_by(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "l_partkey", "parts")
    return links.looked_up(table(spark, sf_dir, "orders").select("o_orderkey"), parts, "o_orderkey").fillna("", ["parts"])


SEEDS = "SELECT DISTINCT 'document' AS seed_type, doc_id::VARCHAR AS seed_value FROM labels WHERE toxic = 1"


def label_seeds(spark, sf_dir):
    return table(spark, sf_dir, "labels").where("toxic = 1").select(F.lit("document").alias("seed_type"), F.col("doc_id").cast("string").alias("seed_value")).distinct()


def document_records(spark, sf_dir):
    fields = F.array(F.struct(F.lit("document").alias("seed_type"), F.col("doc_id").cast("string").alias("value")), F.struct(F.lit("source").alias("seed_type"), F.col("source").alias("value")))
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("object_type"), F.col("doc_id").cast("string").alias("object_id"), fields.alias("fields"))


@query("review_observed", f"SELECT seed_type, seed_value, d.lang AS object_type, seed_value AS object_id, 'observed' AS observation_state FROM ({SEEDS}) s JOIN documents d ON d.doc_id::VARCHAR = s.seed_value")
def review_observed(spark, sf_dir):
    return review.observations(document_records(spark, sf_dir), label_seeds(spark, sf_dir)).select("seed_type", "seed_value", "object_type", "object_id", "observation_state")


@query("review_not_observed", "SELECT 'document' AS seed_type, (item_id * 37)::VARCHAR AS seed_value, CASE WHEN d.doc_id IS NULL THEN 'not observed in captured state' ELSE 'observed' END AS observation_state FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 37")
def review_not_observed(spark, sf_dir):
    seeds = table(spark, sf_dir, "benchmark").select(F.lit("document").alias("seed_type"), (F.col("item_id") * 37).cast("string").alias("seed_value"))
    seen = review.observations(document_records(spark, sf_dir), seeds).select("seed_type", "seed_value", "observation_state")
    return review.with_not_observed(seen, seeds)


@query("review_seed_counts", f"SELECT CASE WHEN d.doc_id IS NULL THEN 'not observed in captured state' ELSE 'observed' END AS observation_state, count(DISTINCT b.item_id) AS seeds FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 37 GROUP BY 1")
def review_seed_counts(spark, sf_dir):
    return review.seed_counts(review_not_observed(spark, sf_dir))


@query("entity_lookup", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def entity_lookup(spark, sf_dir):
    nations = links.looked_up(table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), table(spark, sf_dir, "region"), "r_regionkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return links.looked_up(c, nations, "n_nationkey").select("c_custkey", "n_name", "r_name")


@query("intake_categories", "SELECT category, count(*) AS artifacts, sum(size)::BIGINT AS bytes FROM (SELECT ['diagnostic_archive_or_extract', 'job_or_configuration', 'image_or_graph', 'tabular_export', 'archive', 'log_or_text', 'other'][page_id % 7 + 1] AS category, length(html) AS size FROM pages) GROUP BY 1")
def intake_categories(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("x/hcdiag-1.tar", "x/job.nomad", "x/graph.PNG", "x/rows.csv", "x/all.tar.gz", "x/notes.txt", "x/thing.json")])
    p = table(spark, sf_dir, "pages").select(F.element_at(names, (F.col("page_id") % 7 + 1).cast("int")).alias("path"), F.length("html").alias("size"))
    return p.groupBy(classify.artifact_category(F.col("path")).alias("category")).agg(F.count("*").alias("artifacts"), F.sum("size").alias("bytes"))


@query(
    "window_manifest",
    f"""SELECT 'filtered_lines' AS action, user_id::VARCHAR AS relative_path, count(*) AS matched_lines, {ISO.format('min(ts)')} AS detected_first_timestamp, {ISO.format('max(ts)')} AS detected_last_timestamp,
  'complete source lines with timestamps inside requested window' AS note FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' GROUP BY 2""",
)
def window_manifest(spark, sf_dir):
    line = F.concat(timestamps.iso_utc(F.col("ts")), F.lit(" "), "event_type")
    lines = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("line_no"), line.alias("line"))
    return windows.line_manifest(windows.lines_inside(lines, START, END))


@query(
    "interval_capture_times",
    f"SELECT user_id::VARCHAR AS interval_id, {ISO.format("coalesce(min(ts) FILTER (WHERE event_type = 'view'), min(ts) FILTER (WHERE event_type = 'click'))")} AS ts, CASE WHEN count(*) FILTER (WHERE event_type = 'view') > 0 THEN 'metrics.json' ELSE 'nodes.json' END AS time_source FROM events WHERE event_type IN ('view', 'click') GROUP BY 1",
)
def interval_capture_times(spark, sf_dir):
    e = events(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    name = F.when(F.col("event_type") == "view", "metrics.json").otherwise("nodes.json")
    texts = e.groupBy(F.col("user_id").cast("string").alias("interval_id"), name.alias("name")).agg(F.array_join(F.collect_list(timestamps.iso_utc(F.col("ts"))), " ").alias("text"))
    return iso(windows.interval_times(texts), "ts")


@query("json_first_present", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'b' || event_id ELSE NULL END AS id FROM events""")
def json_first_present(spark, sf_dir):
    from ..functions.records import first_present

    r = F.when(F.col("event_id") % 3 == 0, '{"ID":"","AllocID":"x"}').when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"AllocID":"b'), F.col("event_id").cast("string"), F.lit('"}'))).otherwise('{"ID":null,"AllocID":"x"}')
    return events(spark, sf_dir).select("event_id", first_present(r, ["ID", "AllocID"]).alias("id"))
