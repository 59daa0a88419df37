"""Sharding by size-tiered compaction.

Arrivals become small immutable Parquet files at once. Compaction takes the files under target size
tier by tier (each tier `fanout` times the size of the one below), and merges a tier's run into files of the
target size. Every change is a new manifest: the table of files is written first, then one small
version file is renamed into place, so readers see the old version or the new one. Of two writers the later one
builds on what the earlier committed; files are deleted by vacuum() alone, and only long after.

The driver holds file names (about 100 bytes each), never rows: one for each target_bytes of data and for each
small shard that waits for compaction.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hadoop_path, output_path, table

FILE_SCHEMA = "file string, bytes long, rows long"
MARKS = ("shard_id", "shard_version")
DAY = 86_400


class ConflictError(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    """A versioned set of shards under `root`, a path that all executors share."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fanout: int = 4, min_run: int = 2) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fanout, self.min_run = target_bytes, fanout, min_run

    # manifests -----------------------------------------------------------------------------------
    def versions(self) -> list[int]:
        fs, at = hadoop_path(self.spark, f"{self.root}/versions")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def head(self, version: int | None = None) -> dict | None:
        found = self.versions()
        if version is not None and version not in found:
            raise LookupError(f"version {version} is not there; vacuum() keeps the last ones only")
        if not found:
            return None
        fs, _ = hadoop_path(self.spark, self.root)
        stream = fs.open(self._version_path(version or found[-1]))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def files(self, version: int | None = None) -> DataFrame:
        """file, bytes, rows of a version, the latest by default."""
        head = self.head(version)
        if head is None:
            return self.spark.createDataFrame([], FILE_SCHEMA)
        return self.spark.read.schema(FILE_SCHEMA).parquet(head["table"])

    def _commit(self, files: DataFrame, schema: T.StructType, based_on: int) -> int:
        version = based_on + 1
        name = f"{self.root}/manifests/{version:08d}-{uuid.uuid4().hex[:8]}"
        files.write.parquet(name)
        head = {"version": version, "table": name, "schema": schema.json()}
        fs, temp = hadoop_path(self.spark, f"{self.root}/versions/.tmp-{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps(head).encode()))
        out.close()
        jvm = self.spark._jvm
        final = self._version_path(version)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(temp), fs.makeQualified(final), none)  # fails if the version is there
        except Exception as e:
            fs.delete(temp, False)
            if fs.exists(final):
                raise ConflictError(f"version {version} is taken") from e
            raise
        return version

    def _listed(self, path: str, schema: T.StructType) -> DataFrame:
        """The non-empty files under a path, counted where they lie. No column is read: batches come with
        their number of rows, from the footers."""
        rows = self.spark.read.schema(schema).parquet(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")
        )
        return rows.groupBy("file", "bytes").agg(F.count("*").alias("rows"))

    # changes -------------------------------------------------------------------------------------
    def append(self, df: DataFrame, attempts: int = 20) -> int:
        """Adds df's rows: each of its partitions is a shard. Returns the new version. The data is written once;
        where another writer commits first, only the manifest is made anew. An empty df makes a version
        that names no further file. Columns are those of the first append, by name."""
        head = self.head()
        schema = T.StructType.fromJson(json.loads(head["schema"])) if head else T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
        path = f"{self.root}/data/a{uuid.uuid4().hex[:12]}"
        df.select(*[F.col(f"`{f.name}`") for f in schema]).write.option("compression", "zstd").parquet(path)
        listed = self._listed(path, schema)
        for _ in range(attempts):
            head = self.head()
            try:
                return self._commit(self.files().unionByName(listed), schema, head["version"] if head else 0)
            except ConflictError:
                continue
        raise ConflictError(f"no commit in {attempts} attempts; the data lies in {path}")

    def tier(self, size: int) -> int:
        """0: at least half the target and left alone; k: about fanout^-k of it."""
        if size * 2 >= self.target_bytes:
            return 0
        return max(1, math.ceil(math.log(self.target_bytes / max(size, 1), self.fanout)))

    def compact(self, max_passes: int = 4) -> int:
        """Merges runs of similar small files until no tier holds a run. Returns the version.

        A merge reads a tier's files packed to the target size a task and writes a file a task:
        no shuffle, no key, and no task above the target however large the tier is. What a
        pass makes may be a run of the next tier.
        """
        for _ in range(max_passes):
            head = self.head()
            if head is None:
                return 0
            schema = T.StructType.fromJson(json.loads(head["schema"]))
            small = self.files().where(F.col("bytes") * 2 < self.target_bytes).select("file", "bytes")
            tiers: dict[int, list[str]] = {}
            for r in small.toLocalIterator():  # file names, not rows: one for each small shard
                tiers.setdefault(self.tier(r["bytes"]), []).append(r["file"])
            runs = {t: sorted(f) for t, f in tiers.items() if len(f) >= self.min_run}
            if not runs:
                return head["version"]
            before = self.files().count()
            merged, gone = None, []
            for t, names in sorted(runs.items()):
                path = f"{self.root}/data/c{head['version'] + 1:06d}t{t}-{uuid.uuid4().hex[:8]}"
                self._merge(names, schema, path)
                listed = self._listed(path, schema)
                merged = listed if merged is None else merged.unionByName(listed)
                gone += names
            if self._replace(merged, gone, schema) and self.files().count() >= before:
                break
        return self.head()["version"]

    def _replace(self, merged: DataFrame, gone: list[str], schema: T.StructType, attempts: int = 20) -> bool:
        """Commits merged files in the place of those they hold. False if another compaction took some of
        these first: then what was merged is left to vacuum()."""
        old = self.spark.createDataFrame([(n,) for n in gone], "file string")
        for _ in range(attempts):
            head, files = self.head(), self.files()
            if files.join(old, "file", "left_semi").count() < len(gone):
                return False
            try:
                self._commit(files.join(old, "file", "left_anti").unionByName(merged), schema, head["version"])
                return True
            except ConflictError:
                continue
        return False

    def _merge(self, names: list[str], schema: T.StructType, path: str) -> None:
        session = self.spark.newSession()  # so that no one else's reads are packed like this
        session.conf.set("spark.sql.files.maxPartitionBytes", str(self.target_bytes))
        session.conf.set("spark.sql.files.openCostInBytes", "0")
        session.conf.set("spark.sql.files.minPartitionNum", "1")
        session.read.schema(schema).parquet(*names).write.option("compression", "zstd").parquet(path)

    def vacuum(self, keep_versions: int = 10, min_age_s: float = 7 * DAY) -> int:
        """Forgets all but the last keep_versions versions, then deletes data files that none of these names, if
        they are older than min_age_s; returns how many. min_age_s must exceed what an append or a compaction
        may take from its first file to its commit, and what a reader may take, as their files are not named yet
        or no longer. Versions that stay can be read in full."""
        fs, at = hadoop_path(self.spark, f"{self.root}/data")
        if not fs.exists(at):
            return 0
        before = (time.time() - min_age_s) * 1000
        versions = self.versions()
        for v in versions[:-keep_versions]:
            table_ = self.head(v)["table"]
            fs.delete(self._version_path(v), False)
            fs.delete(hadoop_path(self.spark, table_)[1], True)
        live = set()
        for v in versions[-keep_versions:]:
            live |= {self._name(r["file"]) for r in self.files(v).select("file").toLocalIterator()}
        gone = 0
        found = fs.listFiles(at, True)
        while found.hasNext():
            status = found.next()
            name = status.getPath().toString()
            if name.endswith(".parquet") and self._name(name) not in live and status.getModificationTime() <= before:
                fs.delete(status.getPath(), False)
                gone += 1
        return gone

    @staticmethod
    def _name(file: str) -> str:
        return "/".join(file.split("/")[-2:])  # folder and file, however the path begins

    def _version_path(self, version: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions/v{version:08d}.json")

    # reading -------------------------------------------------------------------------------------
    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with shard_id (the file's folder and name) and shard_version; columns of those
        names in the data give way. The id comes with the file's rows, so nothing is joined."""
        head = self.head(version)
        if head is None:
            raise LookupError(f"nothing was committed under {self.root}")
        schema = T.StructType.fromJson(json.loads(head["schema"]))
        names = [r["file"] for r in self.files(version).select("file").toLocalIterator()]
        data = [F.col(f"`{f.name}`") for f in schema if f.name.lower() not in MARKS]
        mark = F.lit(head["version"]).alias("shard_version")
        if not names:
            return self.spark.createDataFrame([], schema).select(*data, F.lit(None).cast("string").alias("shard_id"), mark)
        shard_id = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+/[^/]+)$", 1)
        return self.spark.read.schema(schema).parquet(*names).select(*data, shard_id.alias("shard_id"), mark)


def shard(docs: DataFrame, root: str | None = None, target_bytes: int = 128 << 20) -> DataFrame:
    """docs, appended to a store as they come and compacted, read back by the committed manifest:
    all rows and columns, repeated rows included, with shard_id and shard_version. root: where the store is or is
    to be, by default a new place in the shared folder. The store stays there; vacuum() is the caller's."""
    spark = docs.sparkSession
    store = ShardStore(spark, root or output_path(spark, "shards"), target_bytes)
    store.append(docs)
    store.compact()
    return store.read()


def op7_shard(spark, sf_dir: str) -> DataFrame:
    """doc_id, shard_id, shard_version and n_bytes of every document, as the committed shards hold them."""
    docs = table(spark, sf_dir, "documents")
    return shard(docs).select("doc_id", "shard_id", "shard_version", F.octet_length("text").cast("long").alias("n_bytes"))
