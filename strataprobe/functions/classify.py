"""Classifiers: ordered rules as CASE expressions, and the fixed word lists they use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes, names and tokens must be these for the same classes to come out.
TEXT_SUFFIXES = [".log", ".txt", ".json", ".jsonl", ".ndjson", ".csv", ".tsv", ".hcl", ".nomad", ".md", ".yaml", ".yml", ".conf", ".cfg", ".out", ".err"]
LINE_SUFFIXES = [".log", ".txt", ".jsonl", ".ndjson", ".csv", ".tsv", ".out", ".err"]
ARCHIVE_SUFFIXES = [".zip", ".tar", ".tgz", ".gz", ".bz2", ".xz", ".7z", ".rar", ".zst"]
SKIPPED_SUFFIXES = [".prof", ".zip", ".tar", ".tgz", ".gz", ".bz2", ".xz", ".7z", ".rar", ".zst", ".png", ".jpg", ".jpeg", ".gif", ".pdf", ".db", ".sqlite", ".sqlite3"]
CASE_SUFFIXES = [".log", ".txt", ".csv", ".tsv", ".png", ".jpg", ".jpeg", ".nomad", ".hcl", ".json", ".tar", ".gz", ".tgz", ".zip"]
ROLES = [
    ("nomad_server_log", r"(nomad.*server|server.*nomad|servers?\.log|/server/|monitor\.log)"),
    ("nomad_client_log", r"(nomad.*client|client.*nomad|syslog.*nomad|/client/|monitor\.log)"),
    ("event_stream", r"(event[-_ ]?stream|task[-_ ]?events?|node[-_ ]?events?|plan[-_ ]?events?|eval(?:uation)?[-_ ]?events?)"),
    ("evaluation", r"(^|[/_.-])eval(?:uation)?s?([/_.-]|$)"),
    ("allocation", r"(^|[/_.-])alloc(?:ation)?s?([/_.-]|$)"),
    ("node", r"(^|[/_.-])nodes?([/_.-]|$)"),
    ("job", r"(^|[/_.-])jobs?([/_.-]|$)"),
    ("deployment", r"(^|[/_.-])deploy(?:ment)?s?([/_.-]|$)"),
    ("raft", r"raft"),
    ("metrics", r"(metrics?|prometheus|telemetry|pprof|profile|heap|goroutine|trace|threadcreate)"),
    ("consul", r"consul"),
    ("vault", r"vault"),
    ("aws", r"(cloudtrail|autoscal|asg|ec2)"),
]
CATEGORY_RANK = {
    "event_stream": 10,
    "allocation_snapshot": 20,
    "evaluation_snapshot": 30,
    "deployment_snapshot": 40,
    "job_snapshot": 50,
    "node_snapshot": 60,
    "scheduler_snapshot": 70,
    "monitor_log": 80,
    "server_log": 90,
    "client_log": 100,
    "metrics": 500,
    "other": 900,
}
HISTORY_RULES = [
    ("task not restarting", ["not restarting"]),
    ("task restart signaled", ["restart signaled"]),
    ("task restarting", ["restarting"]),
    ("disk migration", ["migrate_disk", "migrating data", "snapshot from previous alloc"]),
    ("health check", ["healthcheck", "health check", "check_restart"]),
    ("task killing", ["task killing", " killing"]),
    ("task terminated", ["task terminated", "terminated"]),
    ("task started", ["task started", " started"]),
    ("node drain", ["drain", "draining"]),
    ("allocation reschedule", ["reschedul"]),
    ("allocation migration", ["migrat"]),
    ("template render", ["template-render", "rendering"]),
    ("allocation log record", ["alloc"]),
]
TIMELINE_RULES = [
    ("task not restarting", ["not restarting"]),
    ("task restart signaled", ["restart signaled"]),
    ("task restarting", ["restarting"]),
    ("disk migration", ["migrate_disk", "snapshot from previous alloc"]),
    ("health check", ["healthcheck", "health check", "check_restart"]),
    ("task killing", ["task killing", " killing"]),
    ("task terminated", ["task terminated", "terminated"]),
    ("task started", ["task started", " started"]),
    ("node drain", ["drain", "draining"]),
    ("reschedule", ["reschedul"]),
    ("migration", ["migrat"]),
    ("template render", ["template-render", "rendering"]),
    ("scheduler", ["scheduler", "plan", "evaluation"]),
]
HIGH_TOKENS = ["planresult", "evaluationupdated", "jobregistered", "allocationupdated", "nodedrain", "drain", "migrate", "resched", "restart", "health", "failed", "lost", "blocked"]
MEDIUM_TOKENS = ["allocation observed", "evaluation observed", "node observed", "template render", "scheduler"]
DEBUG_TRAFFIC = ["/v1/agent/pprof/", "/v1/agent/host", "s.rpcHandlerForNode()"]
DUMP_NAME = r"^(?:goroutine-debug1|goroutine-debug2)_\d{4}\.txt$"
PROFILE_NAME = r"^(?:goroutine|goroutine-debug1|goroutine-debug2|heap|profile|threadcreate|trace)_(\d{4})\.(?:prof|txt)$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def any_of(text: Column, tokens: list[str]) -> Column:
    found = F.lit(False)
    for t in tokens:
        found = found | F.contains(text, F.lit(t))
    return found


def first_rule(text: Column, rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The name of the first rule one of whose tokens occurs in the lower-cased text."""
    low = F.lower(text)
    (name, tokens), *rest = rules
    out = F.when(any_of(low, tokens), name)
    for name, tokens in rest:
        out = out.when(any_of(low, tokens), name)
    return out.otherwise(otherwise)


def file_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot; '' for none, for a leading dot alone and for a trailing dot."""
    return F.regexp_extract(file_name(path), r"[^.].*?(\.[^.]+)$", 1)


def file_kind(path: Column) -> Column:
    name, ext = file_name(path), suffix(path)
    packed = name.endswith(".tar.gz") | name.endswith(".tar.bz2") | name.endswith(".tar.xz") | ext.isin(ARCHIVE_SUFFIXES)
    texty = ext.isin(TEXT_SUFFIXES) | ((ext == "") & any_of(name, ["log", "messages", "syslog", "events"]))
    return F.when(packed, "archive").when(texty, "text").otherwise("binary_or_unknown")


def searchable(path: Column) -> Column:
    name, ext = file_name(path), suffix(path)
    bare = (ext == "") & any_of(name, ["log", "messages", "syslog", "events", "output"])
    return ~ext.isin(SKIPPED_SUFFIXES) & (ext.isin(TEXT_SUFFIXES) | bare)


def file_roles(path: Column) -> Column:
    """Comma-joined roles that the path, with a leading slash, has by name; else unknown."""
    rooted = F.concat(F.lit("/"), path)
    roles = F.concat_ws(",", *[F.when(F.regexp_like(rooted, F.lit("(?i)" + p)), role) for role, p in ROLES])
    return F.when(roles == "", "unknown").otherwise(roles)


def path_category(path: Column) -> Column:
    """What a captured file holds. The path is taken with a leading slash, so that server/ and client/ at
    the top count as well as deeper ones."""
    p, name = F.lower(F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/")))), file_name(path)
    log_like = name.endswith(".log") | name.isin("messages", "syslog")
    snapshot = {"allocations": "allocation", "evaluations": "evaluation", "deployments": "deployment", "jobs": "job", "nodes": "node", "operator-scheduler": "scheduler"}
    out = F.when((name == "eventstream.json") | any_of(name, ["event-stream", "event_stream"]), "event_stream")
    for stem, what in snapshot.items():
        out = out.when(name == f"{stem}.json", f"{what}_snapshot")
    out = out.when((name == "metrics.json") | F.contains(p, F.lit("/metrics/")), "metrics").when(name == "monitor.log", "monitor_log")
    out = out.when(F.contains(p, F.lit("/server/")) & log_like, "server_log").when(F.contains(p, F.lit("/client/")) & log_like, "client_log")
    return out.otherwise("other")


def category_rank(category: Column) -> Column:
    out = F.lit(CATEGORY_RANK["other"])
    for name, rank in CATEGORY_RANK.items():
        out = F.when(category == name, rank).otherwise(out)
    return out


def artifact_category(path: Column) -> Column:
    name, ext = file_name(path), suffix(path)
    return (
        F.when(any_of(name, ["hcdiag", "nomad-debug"]), "diagnostic_archive_or_extract")
        .when(ext.isin(".nomad", ".hcl"), "job_or_configuration")
        .when(ext.isin(".png", ".jpg", ".jpeg"), "image_or_graph")
        .when(ext.isin(".csv", ".tsv"), "tabular_export")
        .when(ext.isin(".tar", ".gz", ".tgz", ".zip"), "archive")
        .when(F.contains(name, F.lit("log")) | ext.isin(".log", ".txt"), "log_or_text")
        .otherwise("other")
    )


def history_event(line: Column) -> Column:
    return first_rule(line, HISTORY_RULES, "matching log record")


def timeline_event(line: Column) -> Column:
    return first_rule(line, TIMELINE_RULES, "matching log record")


def relevance(event: Column, details: Column, source_type: Column) -> Column:
    """Labels in the details count like any text: 'drain=false' is high. Kept, as results show it."""
    text = F.lower(F.concat_ws(" ", event, details))
    return (
        F.when(any_of(text, HIGH_TOKENS), "high")
        .when(any_of(text, MEDIUM_TOKENS), "medium")
        .when(source_type.endswith("_monitor_log"), "telemetry")
        .otherwise("medium")
    )


def is_debug_traffic(line: Column) -> Column:
    return any_of(line, DEBUG_TRAFFIC)
