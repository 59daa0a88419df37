"""Shared pieces of the training-data operators: table access, lineage cuts, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

WHITE_WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Edges of one node from which they are dealt over more tasks, one for each so many.
HUB_EDGES = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset
    and all runs in this one process, a temporary folder set here. On a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strataprobe-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of any path Spark can open."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


_scratch: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    path = output_path(spark, name)
    _scratch[path] = spark
    return path


def output_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder that nothing here deletes."""
    return f"{shared_dir(spark)}/strataprobe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


#: Settings while a cut is written: shuffle files go with the job, and Python gets texts in small batches.
CUT_CONF = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}
_held_lock = threading.Lock()
_held: dict[int, list] = {}  # of a session: how many hold the settings, and what they were before


@contextlib.contextmanager
def cut_settings(spark: SparkSession):
    """CUT_CONF for a while. Threads that share a session share the settings: the first sets them, the last
    puts back what was there."""
    key = id(spark)
    with _held_lock:
        state = _held.setdefault(key, [0, {}])
        if not state[0]:
            state[1] = {k: spark.conf.get(k, None) for k in CUT_CONF}
            for k, v in CUT_CONF.items():
                spark.conf.set(k, v)
        state[0] += 1
    try:
        yield
    finally:
        with _held_lock:
            state[0] -= 1
            if not state[0]:
                for k, v in _held.pop(key)[1].items():
                    spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def broadcast_bytes(spark: SparkSession) -> int:
    """The session's own bound on what joins broadcast unasked."""
    text = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10m").strip().lower()
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    digits = text.rstrip("bkmg")
    return int(digits) * next((scale[c] for c in text[len(digits):] if c in scale), 1)


def row_bytes(df: DataFrame) -> int:
    """A row's size in memory, about: 8 bytes a number, 32 a text or bytes, 64 a list."""
    wide = {"string": 32, "binary": 32}
    return 16 + sum(64 if "<" in kind else wide.get(kind, 8) for _, kind in df.dtypes)


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and the files outlive any executor.
    The shuffle files that made it go at once, as nothing reads them again. The table stays until
    unwritten(), release_scratch() or the end of the session.

    The files are packed well, as they wait on disk, so the planner would take a table for far smaller than it
    is in memory. Its rows are counted on the way, and from the session's broadcast bound on it is
    joined by merging."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    seen = Observation()
    with cut_settings(spark):
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    rows = seen.get["rows"]
    if rows * row_bytes(out) > broadcast_bytes(spark):
        out = out.hint("merge")
    out.scratch, out.rows = path, rows
    return out


def unwritten(df: DataFrame) -> None:
    """Deletes what written() wrote for df; only when nothing is to read it again."""
    release_scratch(df.scratch)


def release_scratch(path: str | None = None) -> None:
    """Deletes one written table, or all. Only when no DataFrame built on it is still to run."""
    for p in [path] if path else list(_scratch):
        spark = _scratch.pop(p, None)
        try:
            fs, at = hadoop_path(spark, p)
            fs.delete(at, True)
        except Exception:  # the session may be gone; its shared folder goes with it
            pass


atexit.register(release_scratch)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. translate() is exact but slow, so that plain ASCII takes lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges (src, dst).

    Alternating large-star and small-star rounds, so the rounds grow with the logarithm of a
    component's size, not with its diameter. Minima are pre-aggregated before the shuffle; the edges of a
    node with over HUB_EDGES of them are dealt over a task for each so many. Nothing is collected but one
    row of counts a round. Nodes without edges are not returned; null ends are dropped.
    """
    cur = (
        edges.select("src", "dst")
        .where("src is not null and dst is not null and src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    cur = written(cur, "edges")
    seen = None
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now, salts = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first(), None
        if now == seen:
            break
        seen = now
        if cur.rows > HUB_EDGES:  # a node's edges in either star are no more than it has now
            degrees = both.groupBy("u").agg(F.count("*").alias("degree")).where(F.col("degree") > HUB_EDGES)
            salts = degrees.select("u", (F.col("degree") / HUB_EDGES).cast("int").alias("last"))
            salts = salts if salts.take(1) else None
        large = _star(both, F.col("v") > F.col("u"), salts, keep_self=False)
        small = _star(large, F.lit(True), salts, keep_self=True)
        before, cur = cur, written(small, "edges")
        unwritten(before)
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _star(pairs: DataFrame, emit: Column, salts: DataFrame | None, keep_self: bool) -> DataFrame:
    """Hangs the neighbours of every u on the least of u and its neighbours. salts(u, last): the hubs."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if salts is None:
        met = pairs.join(least, "u")
    else:
        deal = F.coalesce("last", F.lit(0))
        wide = least.join(salts, "u", "left").select("u", "m", F.explode(F.sequence(F.lit(0), deal)).alias("salt"))
        dealt = pairs.join(salts, "u", "left").select("u", "v", F.pmod(F.hash("v"), deal + 1).alias("salt"))
        met = dealt.join(wide, ["u", "salt"])
    out = met.where(emit).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if keep_self:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
