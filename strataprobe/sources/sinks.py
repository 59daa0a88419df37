"""Report files: CSV, JSON and Markdown; run directories."""

from __future__ import annotations

import csv
import io
import json
import os
import shutil
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import cut
from .placed import csv_rows, write_placed


class RunExists(FileExistsError):
    """The run directory is there and must not be replaced."""


def run_directory(path: str | Path, overwrite: bool = False) -> Path:
    """A fresh directory; an existing one is refused, or, to overwrite, removed first."""
    path = Path(path)
    if path.exists():
        if not overwrite:
            raise RunExists(f"{path} exists; overwriting was not asked for")
        shutil.rmtree(path)
    path.mkdir(parents=True)
    return path


def csv_file(df: DataFrame, path: str | Path, order: list | None = None) -> int:
    """One CSV file with header, written by many tasks, in df's order, or in the order given. Returns the number of rows."""
    path = Path(path)
    header = io.StringIO()
    csv.writer(header).writerow(df.columns)
    rows = df.withColumn("data", csv_rows(df)).withColumn("file", F.lit(path.name))
    n = write_placed(rows, path.parent, order, header.getvalue()).get(path.name, 0)
    if not n:
        path.write_text(header.getvalue(), encoding="utf-8", newline="")
    return n


def copied(files: DataFrame, folder: str | Path) -> None:
    """files(rel, path): copies below folder, made by many tasks; each appears under its name when it is whole."""
    target = str(folder)

    def run(frames):
        for frame in frames:
            for rel, path in zip(frame["rel"], frame["path"]):
                to = Path(target) / rel
                to.parent.mkdir(parents=True, exist_ok=True)
                part = to.with_name(f"{to.name}.part-{uuid.uuid4().hex[:12]}")
                shutil.copyfile(path.removeprefix("file://"), part)
                os.replace(part, to)
            yield frame[["rel"]]

    slots = files.sparkSession.sparkContext.defaultParallelism * 4
    files.repartition(slots, "rel").mapInPandas(run, "rel string").agg(F.count("*")).collect()


def csv_directory(df: DataFrame, path: str) -> None:
    """The same by Spark's own writer, in parts, for results that one file should not hold."""
    df.write.option("header", True).csv(path)


def json_file(value, path: str | Path) -> None:
    """A value as JSON. A DataFrame, or one that is a member of a dictionary, is the list of all its rows, in its order; lists of over
    SHORT rows are written by many tasks, a row a line."""
    path, long = Path(path), {}

    def placed(x):
        if not isinstance(x, DataFrame):
            return x
        rows = x.limit(SHORT + 1).collect()
        if len(rows) <= SHORT:
            return [r.asDict(recursive=True) for r in rows]
        mark = uuid.uuid4().hex
        long[mark] = x
        return mark

    held = {k: placed(v) for k, v in value.items()} if isinstance(value, dict) else placed(value)
    text = json.dumps(held, indent=2, default=str) + "\n"
    if not long:
        path.write_text(text, encoding="utf-8")
        return
    spark, parts = next(iter(long.values())).sparkSession, []
    rows = None
    for k, (mark, x) in enumerate(long.items()):  # marks stand in the order they were made in
        before, _, text = text.partition(f'"{mark}"')
        parts += [(2 * k, 0, before + "[\n"), (2 * k + 2, -1, "\n]")]
        plain = [F.col(f"`{c}`").cast("string").alias(c) if kind.startswith(("timestamp", "date")) else F.col(f"`{c}`") for c, kind in x.dtypes]
        lines = cut(x.select(F.monotonically_increasing_id().alias("id"), F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}).alias("line")))
        first = lines.agg(F.min("id")).first()[0]
        lines = lines.select(F.lit(2 * k + 1).alias("k"), "id", F.concat(F.when(F.col("id") > first, ",\n").otherwise(""), "line").alias("data"))
        rows = lines if rows is None else rows.unionByName(lines)
    rows = rows.unionByName(spark.createDataFrame([*parts, (2 * len(long), 1, text)], "k int, id long, data string"))
    write_placed(rows.withColumn("file", F.lit(path.name)), path.parent, ["k", "id"])


def rows_of(df: DataFrame, most: int = 100_000) -> list[dict]:
    """A bounded result as dictionaries; more than `most` rows is an error, not a cut."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"over {most} rows for a report that is held as a whole")
    return rows


def cell(value) -> str:
    return "" if value is None else str(value).replace("|", "\\|").replace("\n", " ")


def markdown_table(columns: list[str], rows: Iterable[Iterable]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(cell(v) for v in row) + " |" for row in rows]
    return "\n".join(lines) + "\n"


#: Rows of a Markdown table up to which the driver writes it; larger ones are written by many tasks.
SHORT = 2000


def markdown_cells(df: DataFrame) -> Column:
    """A row of df as a line of a Markdown table."""
    cells = [F.replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")) for c in df.columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |\n"))


def first_of(items: list[str], most: int, what: str) -> str:
    """The first items of a list for reading, a line each, and how many more there are."""
    more = [f"- … {len(items) - most} more {what}"] if len(items) > most else []
    return "\n".join([f"- {x}" for x in items[:most]] + more)


def markdown_file(path: str | Path, title: str, *sections: tuple[str, str | DataFrame]) -> None:
    """A title and sections (heading, body). A body that is a DataFrame is a table of all its rows, in its order."""
    path = Path(path)
    parts: list[str | DataFrame] = [f"# {title}\n"]
    for head, body in sections:
        if isinstance(body, DataFrame):
            rows = body.limit(SHORT + 1).collect()
            if len(rows) > SHORT:
                parts += [f"\n## {head}\n\n{markdown_table(body.columns, [])}", body]
                continue
            body = markdown_table(body.columns, (list(r) for r in rows))
        parts.append(f"\n## {head}\n\n{body.rstrip()}\n")
    if all(isinstance(x, str) for x in parts):
        path.write_text("".join(parts), encoding="utf-8")
        return
    spark = next(x for x in parts if isinstance(x, DataFrame)).sparkSession
    rows = spark.createDataFrame([(k, 0, x) for k, x in enumerate(parts) if isinstance(x, str)], "k int, id long, data string")
    for k, x in enumerate(parts):
        if isinstance(x, DataFrame):  # its partitions are in order, so this number is
            rows = rows.unionByName(x.select(F.lit(k).alias("k"), F.monotonically_increasing_id().alias("id"), markdown_cells(x).alias("data")))
    write_placed(rows.withColumn("file", F.lit(path.name)), path.parent, ["k", "id"])
