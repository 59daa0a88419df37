"""Captured files as rows: lines, JSON records, events.

Whole documents must be told from concatenated or cut ones, and no JVM parser does that (they return the first
document of several and call it well), so records are told in Python. Files are opened by Spark (splits.py), large ones by
many tasks, and everything after is column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graphs
from . import splits
from .splits import compact

WRAPPERS = {
    "allocations.json": ["Allocations", "Items"],
    "evaluations.json": ["Evaluations", "Items"],
    "jobs.json": ["Jobs", "Items"],
    "nodes.json": ["Nodes", "Items"],
    "deployments.json": ["Deployments", "Items"],
}
RECORDS = "rel string, mode string, elem_idx int, record_json string"
BATCH = 2000
SNAPSHOT = r"(?:^|/)interval/([0-9]+)/([^/]+)$"


def parse_documents(text: str) -> tuple[list[tuple[int, object]], str]:
    """((line, value) of each document, mode): empty, json, json-lines or unparseable. Lines that don't parse
    are left out if any does."""
    if not text.strip():
        return [], "empty"
    try:
        return [(1, json.loads(text))], "json"
    except ValueError:
        pass
    found = []
    for number, line in enumerate(text.splitlines(), 1):
        if line := line.strip():
            try:
                found.append((number, json.loads(line)))
            except ValueError:
                continue
    return (found, "json-lines") if found else ([], "unparseable")


def unwrapped(value, wrappers: Iterable[str], ids: Iterable[str] | None) -> list[dict]:
    """The records in one document: objects of a list, or of the first wrapper key that holds a list, or the
    object itself if no ids are asked for or its first present one is not empty."""
    if isinstance(value, dict):
        inner = next((value[k] for k in wrappers if isinstance(value.get(k), list)), None)
        if inner is None:
            own = next((value[k] for k in ids if k in value), None) if ids is not None else True
            return [value] if own else []
        value = inner
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def nested_with_id(value, ids: list[str], wanted: str) -> Iterator[dict]:
    """Objects at any depth one of whose id keys is the wanted id; outer ones first."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if any(v.get(k) == wanted for k in ids):
                yield v
            stack.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            stack.extend(reversed(v))


def _frames(names: list[str], rows):
    """Rows as frames of BATCH at most."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def may_hold(line: Column, needles: list[str]) -> Column:
    """False only of lines whose records, written compactly, hold none of the needles. A word of letters, digits, - and _, in quotes or
    not, that can be no part of a number stands in a line as in its records, unless that has escapes."""
    word = re.compile(r'"[\w-]+"|[\w-]*(?:[^\W\deE]|[\deE]-\d*-|\d-)[\w-]*', re.A)
    if not needles or not all(word.fullmatch(n) for n in needles):
        return F.lit(True)
    found = F.contains(line, F.lit("\\"))
    for n in needles:
        found |= F.contains(line, F.lit(n))
    return found


def _line_values(lines: DataFrame, read) -> DataFrame:
    """lines(rel, block, line_no, line) through read(rel, value), for the lines that are JSON each: rel, block, line_no, inner, record_json.
    A line's rows count from 0; one that gives none keeps a row with null."""
    schema = pa.schema([("rel", pa.string()), ("block", pa.int64()), ("line_no", pa.int64()), ("inner", pa.int64()), ("record_json", pa.string())])

    def run(batches):
        for batch in batches:
            at, inner, records = [], [], []
            rels = batch.column("rel").to_pylist()
            for i, line in enumerate(batch.column("line").to_pylist()):
                if line := line.strip():
                    try:
                        value = json.loads(line)
                    except ValueError:
                        continue
                    for n, x in enumerate(list(read(rels[i], value)) or [None]):
                        at.append(i), inner.append(n), records.append(x)
            kept = batch.select(["rel", "block", "line_no"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(c.cast(t.type) for c, t in zip(kept.columns, schema)), pa.array(inner, pa.int64()), pa.array(records, pa.string())], schema=schema)

    return lines.select("rel", "block", "line_no", "line").mapInArrow(run, "rel string, block long, line_no long, inner long, record_json string")


def json_records(files: DataFrame, wrappers: list[str] | None = None, ids: list[str] | None = None, deep_id: tuple[list[str], str] | None = None, whole_bytes: int | None = None, numbered: bool = True) -> DataFrame:
    """files(path, rel, length) -> rel, mode, elem_idx (from 0 in a file), record_json; a file without records keeps one row with its
    mode and null. wrappers: by default those of the file's name. deep_id (keys, id): nested objects of that id instead.

    Files over whole_bytes are read by many tasks: a list's, or a wrapped list's, elements one by one, else lines. A lone object is one
    record and read as a whole. The outermost object of a large file with wrapped lists is not held against a deep id itself, and one
    that is a bare text or number counts as lines. Not numbered: elem_idx of these is null, and no record is shuffled for it."""
    spark = files.sparkSession
    small, large = splits.divided(files, whole_bytes)

    def keys_of(rel):
        return wrappers if wrappers is not None else WRAPPERS.get(rel.rpartition("/")[2], ["Items"])

    def found_in(rel, value):
        return nested_with_id(value, *deep_id) if deep_id else unwrapped(value, keys_of(rel), ids)

    def placed(got: DataFrame, mode: str, order: list[str]) -> DataFrame:
        n = F.lit(None)
        if numbered:
            got, n = splits.ordinals(got, "rel", order, "n"), F.col("n") - 1
        return got.select("rel", F.lit(mode).alias("mode"), n.cast("int").alias("elem_idx"), "record_json")

    def of_texts(texts: DataFrame) -> DataFrame:
        def rows(frames):
            for frame in frames:
                for rel, text in zip(frame["rel"], frame["text"]):
                    docs, mode = parse_documents(text)
                    n = 0
                    for _, value in docs:
                        for record in found_in(rel, value):
                            yield rel, mode, n, compact(record)
                            n += 1
                    if not n:
                        yield rel, mode, None, None

        names = [c.split()[0] for c in RECORDS.split(", ")]
        return texts.mapInPandas(lambda frames: _frames(names, rows(frames)), RECORDS)

    visible = splits.there(spark, large)
    elements, docs = splits.split_documents(spark, visible, numbered=False) if visible else (None, {})
    chosen = {}
    for rel, doc in docs.items():
        if doc["top"] == "[":
            chosen[rel] = None
        elif deep_id and doc["lists"]:
            chosen[rel] = None
        elif key := next((k for k in keys_of(rel) if k in (doc["lists"] or [])), None):
            chosen[rel] = key
    whole = [r for r in large if r not in visible or (r[1] in docs and r[1] not in chosen)]
    out = of_texts(splits.whole_texts(spark, small + whole))
    if gone := [(r[1], "unparseable", None, None) for r in small + whole if not splits.hidden(r) and r not in set(splits.there(spark, small + whole))]:
        out = out.unionByName(spark.createDataFrame(gone, RECORDS))
    if chosen:
        pick = spark.createDataFrame(list(chosen.items()), "rel string, chosen string")
        kept = elements.join(F.broadcast(pick) if len(chosen) <= splits.BROADCAST_ROWS else pick, "rel").where("chosen is null or (key = chosen and not plain)")

        def rows(frames):
            for frame in frames:
                for rel, block, k, value in zip(frame["rel"], frame["block"], frame["k"], frame["value"]):
                    for n, x in enumerate(nested_with_id(json.loads(value), *deep_id)):
                        yield rel, block, k, n, compact(x)

        names = ["rel", "block", "k", "inner", "record_json"]
        if deep_id:
            got = graphs.cut(kept.select("rel", "block", "k", "value").mapInPandas(lambda frames: _frames(names, rows(frames)), "rel string, block long, k long, inner long, record_json string"))
        else:  # elements are compact JSON as they are cut
            got = kept.where("startswith(value, '{')").select("rel", "block", "k", F.lit(0).cast("long").alias("inner"), F.col("value").alias("record_json"))
        got = placed(got, "json", ["k", "inner"])
        out = out.unionByName(got).unionByName(_without(pick, got, F.lit("json")))
    lined = [r for r in visible if r[1] not in docs]
    if lined:
        lines = splits.split_lines(spark, lined)
        parsed = graphs.cut(_line_values(lines, lambda rel, value: map(compact, found_in(rel, value))))
        got = placed(parsed.where("record_json is not null"), "json-lines", ["line_no", "inner"])
        told = lines.groupBy("rel").agg(F.max(F.trim("line") != "").alias("text")).join(parsed.select("rel", F.lit(True).alias("json")).distinct(), "rel", "left")
        mode = F.when(F.col("json"), "json-lines").when(F.col("text"), "unparseable").otherwise("empty")
        out = out.unionByName(got).unionByName(_without(told, got, mode))
    return out


def _without(files: DataFrame, got: DataFrame, mode) -> DataFrame:
    """A row for each of the files that no record was got from."""
    lone = files.select("rel", mode.alias("mode")).join(got.select("rel").distinct(), "rel", "left_anti")
    return lone.select("rel", "mode", F.lit(None).cast("int").alias("elem_idx"), F.lit(None).cast("string").alias("record_json"))


def snapshots(files: DataFrame, artifacts: list[str], **how) -> DataFrame:
    """Records of the interval snapshots of the given names, with interval_id and artifact."""
    rel = F.regexp_extract("rel", SNAPSHOT, 2)
    found = json_records(files.where(rel.isin(artifacts)), **how)
    return found.withColumn("interval_id", F.regexp_extract("rel", SNAPSHOT, 1)).withColumn("artifact", rel)


def event_records(files: DataFrame, whole_bytes: int | None = None, needles: list[str] = ()) -> DataFrame:
    """files of event streams -> rel, line_no, record_json. A list's elements are numbered from 1; a lone object
    is 1; else lines. Wrapped batches stay as they are. Files over whole_bytes are read by many tasks. needles: records that hold
    none of them will not be looked at, so lines that can give no others may be left out."""
    spark = files.sparkSession
    small, large = splits.divided(files, whole_bytes)
    visible = splits.there(spark, large)
    elements, docs = splits.split_documents(spark, visible) if visible else (None, {})
    lists = {rel for rel, doc in docs.items() if doc["top"] == "["}
    whole = [r for r in large if r not in visible or (r[1] in docs and r[1] not in lists)]
    names = ["rel", "line_no", "record_json"]

    def rows(frames):
        for frame in frames:
            for rel, text in zip(frame["rel"], frame["text"]):
                found, mode = parse_documents(text)
                if mode == "json" and isinstance(found[0][1], list):
                    found = list(enumerate(found[0][1], 1))
                for n, value in found:
                    if isinstance(value, dict):
                        yield rel, n, compact(value)

    schema = "rel string, line_no long, record_json string"
    out = splits.whole_texts(spark, small + whole).mapInPandas(lambda frames: _frames(names, rows(frames)), schema)
    if lists:
        out = out.unionByName(elements.where("key is null and startswith(value, '{')").select("rel", F.col("position").alias("line_no"), F.col("value").alias("record_json")))
    lined = [r for r in visible if r[1] not in docs]
    if lined:
        some = splits.split_lines(spark, lined).where(may_hold(F.col("line"), list(needles)))
        objects = _line_values(some, lambda rel, value: [compact(value)] if isinstance(value, dict) else [])
        out = out.unionByName(objects.where("record_json is not null").select("rel", "line_no", "record_json"))
    return out


def text_lines(files: DataFrame) -> DataFrame:
    """files -> path (relative), line_no from 1, line without its end; any line end counts, bad bytes become U+FFFD."""
    return splits.lines(files)


whole_texts, stretches, hashed, unreadable = splits.heads, splits.stretches, splits.hashes, splits.unreadable
