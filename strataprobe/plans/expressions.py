"""Record summaries, detail texts, edges and excerpts as named queries, each with its SQL. Records are those of the
bundle in captured.py: customers as allocations, ten to one as evaluations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, records, text, timestamps
from ..operators import graphs, timeline
from ..sources.tables import document_lines, events, table
from .captured import ALLOC, EVAL, EVALS_SQL, STATUS, _id
from .registry import LINES, query

ISO_OF = "strftime(make_timestamp((1700000000 + {0})::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%SZ')"
PREVIOUS = f"CASE WHEN c_custkey % 10 = 1 THEN '' ELSE {_id(8, '(c_custkey - 1)')} END"
OWN_EVAL = _id(9, "cast(floor(c_custkey / 10) as bigint)")


def alloc_records(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(f"{ALLOC.replace('{0}', '1')} AS record")


def eval_records(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr("cast(floor(c_custkey / 10) as bigint) AS e").distinct().selectExpr(f"{EVAL} AS record")


@query(
    "alloc_summary",
    f"""SELECT {_id(8, 'c_custkey')} AS id, 'job-' || lower(c_mktsegment) AS job_id, 'default' AS namespace, NULL AS task_group, 'node-' || c_nationkey AS node_id, {OWN_EVAL} AS eval_id, 'run' AS desired_status,
  {STATUS.replace('{0}', '1')} AS client_status, {PREVIOUS} AS previous_allocation, {ISO_OF.format('c_custkey')} AS create_time_utc, '' AS modify_time_utc FROM customer""",
)
def alloc_summary(spark, sf_dir):
    flat = records.allocation_summary(F.col("record"))
    wanted = ["id", "job_id", "namespace", "task_group", "node_id", "eval_id", "desired_status", "client_status", "previous_allocation", "create_time_utc", "modify_time_utc"]
    return alloc_records(spark, sf_dir).select(*[flat[c].alias(c) for c in wanted])


@query("eval_summary", f"SELECT {_id(9, 'e')} AS id, 'complete' AS status, CASE WHEN e % 8 = 0 THEN '' ELSE {_id(9, '(e - 1)')} END AS previous_eval, NULL AS next_eval, {ISO_OF.format('e')} AS create_time_utc FROM ({EVALS_SQL})")
def eval_summary(spark, sf_dir):
    flat = records.evaluation_summary(F.col("record"))
    return eval_records(spark, sf_dir).select(*[flat[c].alias(c) for c in ("id", "status", "previous_eval", "next_eval", "create_time_utc")])


@query(
    "record_details",
    f"""SELECT id, 'job=' || job || '; node=' || node || '; eval=' || eval || '; desired=run; client=' || st || CASE WHEN prev = '' THEN '' ELSE '; previous=' || prev END AS as_allocation,
  'client=' || st || '; desired=run; node=' || node || '; eval=' || eval || CASE WHEN prev = '' THEN '' ELSE '; previous=' || prev END AS as_payload
FROM (SELECT {_id(8, 'c_custkey')} AS id, 'job-' || lower(c_mktsegment) AS job, 'node-' || c_nationkey AS node, {OWN_EVAL} AS eval, {STATUS.replace('{0}', '1')} AS st, {PREVIOUS} AS prev FROM customer)""",
)
def record_details(spark, sf_dir):
    r = F.col("record")
    return alloc_records(spark, sf_dir).select(records.first_present(r, records.ALLOCATION_IDS).alias("id"), records.allocation_details(r).alias("as_allocation"), records.payload_details(r).alias("as_payload"))


@query("record_seed_fields", f"SELECT {_id(8, 'c_custkey')} AS id, unnest(['allocation_id', 'evaluation_id', 'job_id', 'node_id']) AS seed_type, unnest([{_id(8, 'c_custkey')}, {OWN_EVAL}, 'job-' || lower(c_mktsegment), 'node-' || c_nationkey]) AS value FROM customer")
def record_seed_fields(spark, sf_dir):
    r = F.col("record")
    return alloc_records(spark, sf_dir).select(records.get(r, "ID").alias("id"), F.explode(records.seed_fields(r, F.lit("allocations.json"))).alias("f")).select("id", "f.seed_type", "f.value")


@query("event_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS own, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS deeper FROM events")
def event_times(spark, sf_dir):
    sec = F.unix_seconds("ts").cast("string")
    iso = timestamps.iso_utc(F.timestamp_seconds(F.unix_seconds("ts")))
    kind = F.col("event_id") % 4
    own = F.when(kind == 0, F.concat(F.lit('{"Timestamp":"'), iso, F.lit('"}'))).when(kind == 1, F.concat(F.lit('{"Timestamp":"no time","Time":'), sec, F.lit("}")))
    own = own.when(kind == 2, F.concat(F.lit('{"Payload":{"Allocation":{"CreateTime":'), sec, F.lit('000000000}}}'))).otherwise(F.concat(F.lit('{"Payload":{"Node":{"ModifyTime":'), sec, F.lit("000},\"Allocation\":{}}}")))
    deeper = F.concat(F.lit('{"Payload":{"Time":"'), iso, F.lit('"}}'))
    read = lambda r, **how: timestamps.iso_utc(records.event_time(r, ["Allocation", "Node"], **how))
    return events(spark, sf_dir).select("event_id", read(own).alias("own"), read(deeper, payload_level=True).alias("deeper"))


SEEN = "CASE WHEN user_id % 2 = 0 THEN 'server' ELSE 'client' END"
MESSAGE = "'worker reports ' || event_type || CASE event_type WHEN 'error' THEN ' and is restarting the task' ELSE ' with nothing else to say' END"


@query(
    "log_dedupe",
    f"""WITH h AS (SELECT strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%SZ') AS ts, {SEEN} || '/u' || user_id || '/monitor.log' AS path, {SEEN} AS side, event_id::INT AS line_no, {MESSAGE} AS message FROM events),
g AS (SELECT ts, message, count(*) AS n, min(path) AS path, min_by(line_no, (path, line_no)) AS line_no, min_by(side, (path, line_no)) AS side, string_agg(DISTINCT path, ' + ' ORDER BY path) AS paths, string_agg(DISTINCT side, ',' ORDER BY side) AS sides FROM h GROUP BY 1, 2),
x AS (SELECT *, replace(ts, 'Z', '+0000') || ' ' || message AS line, CASE WHEN contains(message, 'error') THEN strpos(message, 'error') WHEN contains(message, 'reports') THEN strpos(message, 'reports') END + 25 - 1 AS pos FROM g),
y AS (SELECT *, length(line) AS len, CASE WHEN contains(message, 'reports') THEN strpos(message, 'reports') + 25 - 1 END AS spot FROM x),
z AS (SELECT *, greatest(0, spot - 12) AS b, least(len, greatest(0, spot - 12) + 24) AS e FROM y)
SELECT ts, CASE WHEN n > 1 THEN 'correlated_monitor_log' ELSE side || '_monitor_log' END AS source_type, CASE WHEN n > 1 THEN paths ELSE path END AS source_file, CASE WHEN n = 1 THEN line_no END AS source_line,
  CASE WHEN contains(message, 'restarting') THEN 'task restarting' ELSE 'matching log record' END AS event, CASE WHEN b > 0 THEN '… ' ELSE '' END || substr(line, b + 1, e - b) || CASE WHEN e < len THEN ' …[truncated]' ELSE '' END AS details, sides AS source_group FROM z""",
)
def log_dedupe(spark, sf_dir):
    """Equal messages of one minute, stamped with an offset, from whatever file."""
    e = events(spark, sf_dir).withColumn("ts", F.date_trunc("minute", "ts"))
    stamp = F.replace(timestamps.iso_utc(F.col("ts")), F.lit("Z"), F.lit("+0000"))
    lines = e.select(F.expr(f"{SEEN} || '/u' || user_id || '/monitor.log'").alias("path"), F.expr(SEEN).alias("side"), F.col("event_id").cast("int").alias("line_no"), F.concat(stamp, F.lit(" "), F.expr(MESSAGE)).alias("line"))
    needles = ["error", "reports"]
    out = timeline.correlated_log_events(timeline.matching_log_lines(lines, needles), needles, 24)
    return out.select(timestamps.iso_utc(F.col("ts")).alias("ts"), "source_type", "source_file", "source_line", "event", "details", "source_group")


TRACKER = f"""CASE WHEN c_custkey % 7 = 0 THEN '{{"Events":[{{"PrevAllocID":"' || {_id(8, '(c_custkey - 2)')} || '","PrevNodeID":"n' || cast(c_nationkey as string) || '","RescheduleTime":"t"}}]}}' END"""
NEXT = f"CASE WHEN c_custkey % 5 = 0 THEN {_id(8, '(c_custkey + 1)')} END"


@query(
    "alloc_edges",
    f"""SELECT {_id(8, '(c_custkey - 1)')} AS src, {_id(8, 'c_custkey')} AS dst, 'previous_allocation' AS relation, 'allocation_field' AS source_type, 'a, b, c' AS source_file, 'PreviousAllocation' AS detail, NULL AS node_id, NULL AS at FROM customer WHERE c_custkey % 10 <> 1
UNION ALL SELECT {_id(8, 'c_custkey')}, {_id(8, '(c_custkey + 1)')}, 'next_allocation', 'allocation_field', 'a, b, c', 'NextAllocation', NULL, NULL FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT {_id(8, '(c_custkey - 2)')}, {_id(8, 'c_custkey')}, 'reschedule_tracker', 'allocation_field', 'a, b, c', 'RescheduleTracker.Events', 'n' || c_nationkey, 't' FROM customer WHERE c_custkey % 7 = 0""",
)
def alloc_edges(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr(f"{_id(8, 'c_custkey')} AS id", f"{PREVIOUS} AS previous_allocation", f"{NEXT} AS next_allocation", f"{TRACKER} AS reschedule_tracker", "array('a', 'b', 'c', 'd') AS sources")
    return graphs.allocation_edges(c.unionByName(c)).select(graphs.EDGE_COLUMNS)  # each seen twice


@query(
    "eval_edges",
    f"""SELECT {_id(9, '(e - 1)')} AS src, {_id(9, 'e')} AS dst, 'previous_eval' AS relation, 'x' AS source_file, 'PreviousEval' AS detail FROM ({EVALS_SQL}) WHERE e % 8 <> 0
UNION ALL SELECT {_id(9, 'e')}, {_id(9, '(e + 3)')}, 'next_eval', 'x', 'NextEval' FROM ({EVALS_SQL}) WHERE e % 3 = 0 UNION ALL SELECT {_id(9, 'e')}, {_id(9, '(e * 2)')}, 'blocked_eval', 'x', 'BlockedEval' FROM ({EVALS_SQL}) WHERE e % 4 = 1""",
)
def eval_edges(spark, sf_dir):
    e = table(spark, sf_dir, "customer").selectExpr("cast(floor(c_custkey / 10) as bigint) AS e").distinct()
    e = e.selectExpr(f"{_id(9, 'e')} AS id", f"CASE WHEN e % 8 = 0 THEN '' ELSE {_id(9, '(e - 1)')} END AS previous_eval", f"CASE WHEN e % 3 = 0 THEN {_id(9, '(e + 3)')} END AS next_eval", f"CASE WHEN e % 4 = 1 THEN {_id(9, '(e * 2)')} END AS blocked_eval", "array('x') AS sources")
    return graphs.evaluation_edges(e).select("src", "dst", "relation", "source_file", "detail")


NAMES = ["a/monitor.log", "a/x.json", "heap_0001.prof", "pic.png", "a/syslog", "a/output", "data", "b.tar.gz"]


@query("searchable_files", f"SELECT searchable, count(*) AS files, sum(length(html))::BIGINT AS chars FROM (SELECT html, (page_id % 8) IN (0, 1, 4, 5) AS searchable FROM pages) GROUP BY 1")
def searchable_files(spark, sf_dir):
    path = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("page_id") % 8 + 1).cast("int"))
    p = table(spark, sf_dir, "pages").select(classify.searchable(path).alias("searchable"), F.length("html").alias("n"))
    return p.groupBy("searchable").agg(F.count("*").alias("files"), F.sum("n").alias("chars"))


@query("text_forms", "SELECT doc_id, substr(text, 1, 8) AS short, sha256(coalesce(replace(replace(text, '|', '\\|'), chr(10), ' '), '')) AS cell, sha256(CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || ' …[truncated]' ELSE text END) AS cut FROM documents")
def text_forms(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.short_id(t).alias("short"), F.sha2(text.markdown_cell(t), 256).alias("cell"), F.sha2(text.truncated(t, 400), 256).alias("cut"))


@query("line_cap", f"SELECT path, line_no, line FROM ({LINES}) WHERE contains(line, 'the') ORDER BY path, line_no LIMIT 100")
def line_cap(spark, sf_dir):
    return timeline.first_by_place(document_lines(spark, sf_dir).where(F.contains("line", F.lit("the"))), 100)
