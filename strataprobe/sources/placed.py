"""Report files written by many tasks and committed at once.

The bytes of each partition are counted first, so every task knows where in its files its rows begin and writes them
there, into a file beside the final one. A task that runs again writes the same bytes to the same places. When all are done
the driver, which has seen counts alone, checks the sizes and renames; if the job fails, nothing is left. The folder must be one that all
machines mount.
"""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.graphs import cut
from ..operators.ordinals import fixed_order, part_offsets

FORMAT = "strataprobe-placed"


class Written(WriterCommitMessage):
    def __init__(self, sizes: dict[str, int]):
        self.sizes = sizes


def joined(texts: pa.Array) -> memoryview:
    """The bytes of texts one after another: in an Arrow column they lie so."""
    _, ends, raw = texts.buffers()
    if raw is None:
        return memoryview(b"")
    wide = 8 if pa.types.is_large_string(texts.type) else 4
    at = memoryview(ends).cast("B").cast("q" if wide == 8 else "i")
    return memoryview(raw)[at[texts.offset] : at[texts.offset + len(texts)]]


class PlacedWriter(DataSourceArrowWriter):
    """Rows (file, data): each task appends its data to its files from its own offset on."""

    def __init__(self, options):
        self.folder, self.mark = options["folder"], options["mark"]
        self.offsets: dict[str, dict[str, int]] = json.loads(options["offsets"])
        self.sizes: dict[str, int] = json.loads(options["sizes"])

    def staged(self, name: str) -> Path:
        path = Path(self.folder) / name
        return path.with_name(f"{path.name}.{self.mark}")

    def write(self, iterator):
        at = dict(self.offsets.get(str(TaskContext.get().partitionId()), {}))
        done: dict[str, int] = {}
        for batch in iterator:
            files, data = batch.column("file"), batch.column("data")
            names = files.unique().to_pylist()
            for name in names:
                raw = joined(data if len(names) == 1 else data.filter(pc.equal(files, name)))
                handle = os.open(self.staged(name), os.O_WRONLY)
                try:
                    os.pwrite(handle, raw, at[name])
                finally:
                    os.close(handle)
                at[name] += len(raw)
                done[name] = done.get(name, 0) + len(raw)
        return Written(done)

    def commit(self, messages):
        got: dict[str, int] = {}
        for m in messages:
            for name, n in (m.sizes if m else {}).items():
                got[name] = got.get(name, 0) + n
        if got != {k: v for k, v in self.sizes.items() if v}:
            raise OSError("the bytes written are not those that were counted")
        for name in self.sizes:
            os.replace(self.staged(name), Path(self.folder) / name)

    def abort(self, messages):
        for name in self.sizes:
            self.staged(name).unlink(missing_ok=True)


class PlacedSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "file string, data string"

    def writer(self, schema, overwrite):
        return PlacedWriter(self.options)


def write_placed(rows: DataFrame, folder: str | Path, order: list | None, head: str | dict[str, str] = "", tail: str | dict[str, str] = "", fixed: bool = False) -> dict[str, int]:
    """rows(file, data, ..): the data of each file, in order (which must begin with the file; None: as the rows' partitions have
    them), as one file below folder, after head; heads and tails may be given by file. Returns the number of rows of each. Existing files
    are replaced, all together or none. fixed: the rows are computed, without a shuffle, from a table whose partitions a checkpoint
    holds, so they need none of their own."""
    spark = rows.sparkSession
    if fixed:
        fixed_rows = rows.select("file", "data")
    else:
        fixed_rows = cut(rows.select("file", "data")) if order is None else fixed_order(rows, order)
    size = F.octet_length("data")
    parts = part_offsets(fixed_rows, size, ["file"]).collect()
    counts: dict[str, int] = {}
    begins = lambda name: (head if isinstance(head, str) else head.get(name, "")).encode("utf-8")
    ends = lambda name: (tail if isinstance(tail, str) else tail.get(name, "")).encode("utf-8")
    offsets: dict[str, dict[str, int]] = {}
    sizes: dict[str, int] = {}
    for r in parts:
        offsets.setdefault(str(r["part"]), {})[r["file"]] = len(begins(r["file"])) + r["before"]
        sizes[r["file"]] = sizes.get(r["file"], 0) + r["n"]
        counts[r["file"]] = counts.get(r["file"], 0) + r["rows"]
    if not sizes:
        return {}
    mark = f"part-{uuid.uuid4().hex[:12]}"
    writer = {"folder": str(folder), "mark": mark, "offsets": json.dumps(offsets), "sizes": json.dumps(sizes)}
    for name, n in sizes.items():
        path = Path(folder) / name
        path.parent.mkdir(parents=True, exist_ok=True)
        first = begins(name)
        with open(path.with_name(f"{path.name}.{mark}"), "wb") as f:
            f.write(first)
            f.truncate(len(first) + n)
            f.seek(len(first) + n)
            f.write(ends(name))
    spark.dataSource.register(PlacedSource)
    try:
        fixed_rows.select("file", "data").write.format(FORMAT).mode("append").options(**writer).save()
    except BaseException:
        PlacedWriter(writer).abort([])
        raise
    return counts


def csv_cell(column: Column, kind: str) -> Column:
    """A value as a CSV cell: quoted if it holds a comma, quote or line end; null is empty."""
    text = F.when(column, "True").otherwise("False") if kind == "boolean" else column.cast("string")
    text = F.when(column.isNull(), "").otherwise(text)
    return F.when(F.regexp_like(text, F.lit('[",\r\n]')), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_rows(df: DataFrame) -> Column:
    """The columns of df as a CSV line with its end."""
    cells = [csv_cell(F.col(f"`{c}`"), kind) for c, kind in df.dtypes]
    line = F.concat_ws(",", *cells)
    if len(cells) == 1:
        line = F.when(line == "", '""').otherwise(line)
    return F.concat(line, F.lit("\r\n"))
