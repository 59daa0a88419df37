"""Expressions over captured JSON records, kept as text: present keys, summaries, fields for comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timestamps import iso_utc, stamp_or_epoch

EMPTY = ["", "null", "[]", "{}"]

ALLOCATION_IDS = ["ID", "AllocID", "AllocationID"]
DEEP_IDS = ["ID", "Id", "id", "AllocID", "AllocationID"]
EVALUATION_IDS = ["ID", "EvalID"]
NODE_IDS = ["ID", "NodeID"]
CREATED = ["CreateTime", "CreateTimestamp", "CreatedAt"]
MODIFIED = ["ModifyTime", "ModifyTimestamp", "UpdatedAt"]


def has_key(record: Column, key: str) -> Column:
    return F.array_contains(F.json_object_keys(record), key)


def get(record: Column, path: str) -> Column:
    """Text of a value: strings as they are, others as JSON; null for null and for missing."""
    return F.get_json_object(record, "$." + path)


def members(record: Column) -> Column:
    """A record's values by key, texts as get() gives them: one parse for all, if it is a column before they are looked up."""
    return F.from_json(record, "map<string,string>")


def first_present(record: Column, keys: list[str], known: Column | None = None) -> Column:
    """The value of the first key that is there, even if that is null or empty. known: the record's members()."""
    out = F
    for key in keys:
        there, value = (has_key(record, key), get(record, key)) if known is None else (F.map_contains_key(known, key), known[key])
        out = out.when(there, value)
    return out


def filled(value: Column) -> Column:
    """value, or null if it is null, empty text, an empty list or an empty object; 0 and false stay."""
    return F.when(~F.coalesce(value, F.lit("")).isin(EMPTY), value)


def or_else(value: Column, other: Column) -> Column:
    """other where value is empty or null."""
    return F.coalesce(F.when(value != "", value), other)


def time_texts(record: Column, known: Column | None = None, **keys: list[str]) -> dict[str, Column]:
    """ISO texts of a record's times, by name. They are read in one array, so that their long expression is there once."""
    read = F.transform(F.array(*[first_present(record, k, known) for k in keys.values()]), lambda x: iso_utc(stamp_or_epoch(x)))
    return {name: read[i] for i, name in enumerate(keys)}


def allocation_summary(record: Column, known: Column | None = None) -> dict[str, Column]:
    """The flat columns of an allocation. known: its members(), if they are there."""
    own = (lambda key: get(record, key)) if known is None else (lambda key: known[key])
    plain = {"node_id": "NodeID", "node_name": "NodeName", "eval_id": "EvalID", "deployment_id": "DeploymentID", "desired_status": "DesiredStatus",
             "client_status": "ClientStatus", "desired_description": "DesiredDescription", "client_description": "ClientDescription"}
    inside = lambda value: F.when(own("Job").isNotNull(), value)
    job = or_else(own("JobID"), inside(first_present(own("Job"), ["ID", "Name"])))
    return {
        "id": F.coalesce(first_present(record, DEEP_IDS, known), F.lit("")),
        "job_id": job,
        "namespace": or_else(own("Namespace"), inside(get(record, "Job.Namespace"))),
        "task_group": first_present(record, ["TaskGroup", "TaskGroupName"], known),
        **{name: own(key) for name, key in plain.items()},
        "previous_allocation": first_present(record, ["PreviousAllocation", "PreviousAllocID"], known),
        "next_allocation": first_present(record, ["NextAllocation", "NextAllocID"], known),
        **time_texts(record, known, create_time_utc=CREATED, modify_time_utc=MODIFIED),
        "reschedule_tracker": own("RescheduleTracker"),
        "desired_transition": own("DesiredTransition"),
        "task_states": own("TaskStates"),
    }


def evaluation_summary(record: Column, known: Column | None = None) -> dict[str, Column]:
    own = (lambda key: get(record, key)) if known is None else (lambda key: known[key])
    plain = {
        "namespace": "Namespace", "job_id": "JobID", "node_id": "NodeID", "deployment_id": "DeploymentID", "triggered_by": "TriggeredBy", "status": "Status",
        "status_description": "StatusDescription", "previous_eval": "PreviousEval", "next_eval": "NextEval", "blocked_eval": "BlockedEval", "priority": "Priority",
        "type": "Type", "failed_tg_allocs": "FailedTGAllocs", "queued_allocations": "QueuedAllocations", "class_eligibility": "ClassEligibility", "annotate_plan": "AnnotatePlan",
    }
    return {
        "id": F.coalesce(first_present(record, EVALUATION_IDS, known), F.lit("")),
        **{name: own(key) for name, key in plain.items()},
        **time_texts(record, known, wait_until_utc=["WaitUntil"], create_time_utc=CREATED[:2], modify_time_utc=MODIFIED[:2]),
    }


def labelled(record: Column, fields: dict[str, str]) -> Column:
    """'label=value; ..' of the keys that hold something."""
    return F.concat_ws("; ", *[F.concat(F.lit(label + "="), filled(get(record, key))) for key, label in fields.items()])


# Keys and labels of detail texts.
ALLOCATION_LABELS = {"JobID": "job", "TaskGroup": "group", "NodeID": "node", "EvalID": "eval", "DeploymentID": "deployment", "DesiredStatus": "desired", "ClientStatus": "client", "PreviousAllocation": "previous", "NextAllocation": "next"}
EVALUATION_LABELS = {"JobID": "job", "Namespace": "namespace", "NodeID": "node", "TriggeredBy": "triggered_by", "Status": "status", "StatusDescription": "status_description", "PreviousEval": "previous_eval", "NextEval": "next_eval", "BlockedEval": "blocked_eval"}
NODE_LABELS = {"Name": "name", "Status": "status", "StatusDescription": "status_description", "SchedulingEligibility": "eligibility", "NodePool": "pool", "NodeClass": "class"}
PAYLOAD_LABELS = {"ClientStatus": "client", "DesiredStatus": "desired", "NodeID": "node", "EvalID": "eval", "DeploymentID": "deployment", "PreviousAllocation": "previous", "NextAllocation": "next", "ClientDescription": "client_description", "DesiredDescription": "desired_description"}


def allocation_details(record: Column) -> Column:
    return labelled(record, ALLOCATION_LABELS)


def evaluation_details(record: Column) -> Column:
    return labelled(record, EVALUATION_LABELS)


def node_details(record: Column) -> Column:
    drain = filled(get(record, "Drain"))
    drain = F.when(F.length(drain) > 180, F.concat(F.substring(drain, 1, 180), F.lit(" …[truncated]"))).otherwise(drain)
    return F.concat_ws("; ", F.when(labelled(record, NODE_LABELS) != "", labelled(record, NODE_LABELS)), F.concat(F.lit("drain="), drain))


def payload_details(record: Column) -> Column:
    states = F.map_entries(F.from_json(get(record, "TaskStates"), "map<string,string>"))
    tasks = F.transform(F.filter(states, lambda e: e["value"].startswith("{")), lambda e: F.concat(e["key"], F.lit(":"), F.coalesce(F.get_json_object(e["value"], "$.State"), F.lit(""))))
    some = labelled(record, PAYLOAD_LABELS)
    return F.concat_ws("; ", F.when(some != "", some), F.when(F.size(tasks) > 0, F.concat(F.lit("tasks="), F.array_join(tasks, ","))))


def event_time(record: Column, kinds: list[str], payload_level: bool = False) -> Column:
    """Time of an event: its own keys, else the payload objects' modify and create times, else (payload_level)
    the payload's own. The record is parsed once, and stamps are read of the keys that are there."""
    paths = ["Timestamp", "Time", "EventTime", *[f"Payload.{kind}.{k}" for kind in kinds for k in ("ModifyTime", "CreateTime")]]
    if payload_level:
        paths += ["Payload.Timestamp", "Payload.Time"]
    parsed = F.try_parse_json(record)
    there = F.array_compact(F.array(*[F.try_variant_get(parsed, "$." + p, "string") for p in paths]))
    return F.try_element_at(F.array_compact(F.transform(there, stamp_or_epoch)), F.lit(1))


SEED_TYPES = {"job_ids": "job_id", "allocation_ids": "allocation_id", "evaluation_ids": "evaluation_id", "node_ids": "node_id", "deployment_ids": "deployment_id"}


def seed_fields(record: Column, artifact: Column, strict: bool = True, known: Column | None = None) -> Column:
    """array<struct<seed_type, value>> of a record's explicit ids. strict: an allocation id is read only off
    allocations; otherwise any record's own id counts as one too. known: its members(), if they are there."""
    get_own = (lambda key: get(record, key)) if known is None else (lambda key: known[key])
    first = lambda *keys: first_present(record, list(keys), known)
    own = first(*ALLOCATION_IDS)
    is_a = lambda name: artifact == name + ".json"
    job = or_else(get_own("JobID"), first_present(F.coalesce(get_own("Job"), F.lit("{}")), ["ID", "Name"]))
    fields = {
        "allocation_id": F.when(is_a("allocations"), own) if strict else own,
        "evaluation_id": F.when(is_a("evaluations"), first("ID", "EvalID", "EvaluationID")).otherwise(first("EvalID", "EvaluationID")),
        "job_id": F.when(is_a("jobs"), first("ID", "Name", "JobID")).otherwise(job),
        "node_id": F.when(is_a("nodes"), first("ID", "NodeID")).otherwise(get_own("NodeID")),
        "deployment_id": F.when(is_a("deployments"), first("ID", "DeploymentID")).otherwise(get_own("DeploymentID")),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("seed_type"), v.alias("value")) for k, v in fields.items()])
    return F.filter(pairs, lambda p: F.coalesce(p["value"], F.lit("")) != "")
