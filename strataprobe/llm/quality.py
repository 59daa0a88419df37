"""Quality classifier: random Fourier features, ridge, isotonic calibration.

Byte and word statistics of the whole text are standardised and lifted by random cosines, whose inner
products approximate a Gaussian kernel. Partitions sum the normal equations of their rows; the driver
solves one bounded system. Out-of-fold scores are calibrated by pool-adjacent-violators.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

STATS = 20


def _byte_tables() -> np.ndarray:
    """Class indicators of the 256 byte values, one row a class."""
    b = np.arange(256)
    space = np.isin(b, [9, 10, 11, 12, 13, 32])
    letter = ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
    upper = (b >= 65) & (b <= 90)
    digit = (b >= 48) & (b <= 57)
    stop = np.isin(b, [33, 46, 63])
    comma = np.isin(b, [44, 58, 59])
    line = b == 10
    high = b >= 0xC0
    symbol = ~(space | letter | digit | stop | comma)
    return np.stack([space, letter, upper, digit, stop, comma, line, high, symbol]).astype(np.int32)


CLASSES = _byte_tables()


def text_stats(raw: bytes) -> np.ndarray:
    """STATS numbers that describe a text; zeros for an empty one."""
    out = np.zeros(STATS)
    n = len(raw)
    if not n:
        return out
    b = np.frombuffer(raw, np.uint8)
    counts = np.bincount(b, minlength=256)
    share = CLASSES @ counts / n
    out[0] = np.log1p(n)
    out[1:10] = share
    p = counts[counts > 0] / n
    out[10] = -(p * np.log2(p)).sum()
    words = raw.split()
    m = len(words)
    if not m:
        return out
    lengths = np.fromiter(map(len, words), np.int64, m)
    distinct = len(set(words))
    out[11] = lengths.mean()
    out[12] = np.log1p(lengths.std())
    out[13] = distinct / m
    out[14] = distinct / np.sqrt(m)
    out[15] = (lengths <= 3).mean()
    out[16] = (lengths == 1).mean()
    out[17] = sum(a == c for a, c in zip(words, words[1:])) / m
    lines = raw.split(b"\n")
    out[18] = len(set(lines)) / len(lines)
    out[19] = np.log1p(n / len(lines))
    return out


@dataclass
class QualityModel:
    """A fitted model; small (a few hundred kB) whatever it was fitted on."""

    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    coef: np.ndarray
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))

    def lift(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        wave = np.cos(z @ self.freq + self.phase) * np.sqrt(2.0 / len(self.phase))
        return np.hstack([wave, z / np.sqrt(z.shape[1]), np.ones((len(z), 1))])

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.lift(stats) @ self.coef, self.knots, self.levels)


def pool_adjacent(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic fit of y on x: knots and levels to interpolate between block centres, so that equal
    blocks do not tie documents of different raw scores."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for xi, yi in zip(x[order], y[order]):
        blocks.append([yi, 1.0, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, w, c = blocks.pop()
            b = blocks[-1]
            total = b[1] + w
            b[0], b[2], b[1] = (b[0] * b[1] + v * w) / total, (b[2] * b[1] + c * w) / total, total
    v, w, c = (np.array(z) for z in zip(*blocks))
    v = (v * w + 0.5) / (w + 1.0)  # no block is surer than its size allows
    v = np.maximum.accumulate(v)
    spread = max(float(c[-1] - c[0]), 1e-9)
    return np.concatenate([[c[0] - spread], c, [c[-1] + spread]]), np.concatenate([[v[0] / 2], v, [(1 + v[-1]) / 2]])


def _raw(text) -> bytes:
    return text.encode("utf-8", "replace") if text is not None else b""


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    max_rows: int = 20000,
    features: int = 256,
    folds: int = 4,
    ridge: float = 1e-3,
    width: float = 4.0,
    seed: int = 7,
) -> QualityModel:
    """Fits on the labelled documents. docs(doc_id, text), labels(doc_id, quality).

    max_rows bounds the labelled rows in use: those of smallest id hash, so the same at any
    partitioning. Null labels and ids are left out; several labels of one id: their mean, rounded. Ids
    may be numbers or texts and are compared as texts. Texts are read whole, whatever their length.
    Without any labelled row every score is 0.5. A text's statistics are computed where it lies; a
    partition returns sums (normal equations per fold), the driver holds folds * features^2 numbers and
    max_rows out-of-fold scores.
    """
    spark = docs.sparkSession
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.round(F.avg("quality")).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    # at most max_rows rows of two numbers, so that the sample may be broadcast
    rows = chosen.collect()
    sample = spark.createDataFrame(rows, chosen.schema).select(F.col("doc_id").cast("string").alias("known"), "y")
    width_cols = ", ".join(f"s{i} double" for i in range(STATS))

    def stats(batches):
        for batch in batches:
            s = np.array([text_stats(_raw(t)) for t in batch.column("text").to_pylist()]).reshape(-1, STATS)
            cols = [batch.column("doc_id"), batch.column("y")] + [pa.array(s[:, i]) for i in range(STATS)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "y"] + [f"s{i}" for i in range(STATS)])

    number = F.coalesce(F.col("doc_id").try_cast("long"), F.xxhash64("doc_id")).alias("doc_id")
    table_ = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id").cast("string") == F.col("known")).select(number, "y", "text")
    stat_rows = written(table_.mapInArrow(stats, f"doc_id long, y int, {width_cols}"), "stats")
    cols = [f"s{i}" for i in range(STATS)]
    base = stat_rows.agg(F.count("*"), *[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    rng = np.random.default_rng(seed)
    freq = rng.normal(size=(STATS, features)) / width
    phase = rng.uniform(0, 2 * np.pi, features)
    size = features + STATS + 1
    if not base[0]:
        return QualityModel(np.zeros(STATS), np.ones(STATS), freq, phase, np.zeros(size), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    mean = np.array(base[1 : 1 + STATS], float)
    scale = np.array(base[1 + STATS :], float)
    scale[scale < 1e-9] = 1.0
    model = QualityModel(mean, scale, freq, phase, np.zeros(size))

    def sums(frames):
        acc = np.zeros((folds, size, size + 1))
        for f in frames:
            x = model.lift(f[cols].to_numpy(float))
            part = fold_of(f["doc_id"].to_numpy(), folds)
            for k in range(folds):
                xk, yk = x[part == k], f["y"].to_numpy(float)[part == k]
                acc[k] += np.hstack([xk.T @ xk, (xk.T @ yk)[:, None]])
        yield pd.DataFrame({"fold": range(folds), "eq": [a.tobytes() for a in acc]})

    eqs = stat_rows.mapInPandas(sums, "fold int, eq binary")

    def add(key, f):
        total = sum(np.frombuffer(e) for e in f["eq"])
        return pd.DataFrame({"fold": [key[0]], "eq": [total.tobytes()]})

    per_fold = np.zeros((folds, size, size + 1))
    for r in eqs.groupBy("fold").applyInPandas(add, "fold int, eq binary").collect():
        per_fold[r["fold"]] = np.frombuffer(bytes(r["eq"])).reshape(size, size + 1)

    def solve(eq):
        lam = ridge * max(1.0, np.trace(eq[:, :-1]) / size)
        return np.linalg.solve(eq[:, :-1] + lam * np.eye(size), eq[:, -1])

    whole = per_fold.sum(axis=0)
    coefs = [solve(whole - per_fold[k]) for k in range(folds)]

    def out_of_fold(frames):
        for f in frames:
            x = model.lift(f[cols].to_numpy(float))
            part = fold_of(f["doc_id"].to_numpy(), folds)
            s = np.choose(part, [x @ c for c in coefs])
            yield pd.DataFrame({"s": s, "y": f["y"]})

    held = stat_rows.mapInPandas(out_of_fold, "s double, y int").orderBy("s", "y").toPandas()  # max_rows at most
    model.coef = solve(whole)
    model.knots, model.levels = pool_adjacent(held["s"].to_numpy(), held["y"].to_numpy(float))
    return model


def fold_of(ids: np.ndarray, folds: int) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(40)) % np.uint64(folds)).astype(np.int64)


def score_udf(model: QualityModel):
    """Column function text -> score (null and empty texts get the score of empty statistics). The model
    is small and travels with the function."""
    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        s = np.array([text_stats(_raw(t)) for t in text]).reshape(-1, STATS)
        return pd.Series(model.score(s))

    return score


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from: crc32 of the id's text, modulo 5, not 0."""
    return labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0)


def op9_quality(spark, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, training_labels(table(spark, sf_dir, "labels")).select("doc_id", "quality"))
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return (
        docs.withColumn("score", score_udf(model)(F.col("text")))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
        .select("doc_id", (F.pmod(crc, F.lit(5)) == 0).alias("held_out"), "score", "predicted")
    )
