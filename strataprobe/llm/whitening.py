"""Embedding whitening: exact covariance of integer vectors by digit slices, then principal components.

Entries become large integers whose spread is small beside their mean, so a covariance summed in doubles would lose most
of its digits. Here vectors are centred as n*x - S, an integer, cut into small limbs, and multiplied limb by
limb in BLAS: every product and partial sum stays below 2^53 and so exact. Tasks put the limbs together as big integers, Spark adds
these up in words of 30 bits, and the driver sees one row for each pair of dimensions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, unwritten, written

SCALE, SHIFT = 64, 1_000_000
#: 64 * entry beyond this counts as this, so that x is a long.
EDGE = 2.0**62
LIMB = 20
#: Rows of one product: 2^13 products of two limbs below 2^20 stay below 2^53.
BLOCK = 1 << (53 - 2 * LIMB)
WORD = 30
PRIMES = (2**31 - 1, 2**31 - 19)


def vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, x of the rows whose vector is there and has finite entries alone.

    All vectors must have one length: rows of another than the most common (of equal ones the greatest) lack
    entries or have unknown ones and are dropped like those with nulls, empty vectors too."""
    vec = F.col(f"`{vec_col}`")
    bad = F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    good = rows.select(F.col(f"`{id_col}`").alias("vec_id"), vec.alias("v")).where(vec.isNotNull() & (F.size(vec) > 0) & ~bad)
    lengths = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), F.col("d").desc()).first()
    scaled = lambda c: F.least(F.greatest(c.cast("double") * SCALE, F.lit(-EDGE)), F.lit(EDGE))
    x = F.transform("v", lambda c: F.floor(scaled(c)) + F.lit(SHIFT).cast("long"))
    return good.where(F.size("v") == (lengths["d"] if lengths else 0)).select("vec_id", x.alias("x"))


def matrix(column) -> np.ndarray:
    """The rows of an Arrow list column as one array of longs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def centred(x: np.ndarray, n: int, total: np.ndarray, wide: bool) -> np.ndarray:
    """n*x - S, exactly. Where results fit into longs, arithmetic that wraps around gives them; else big integers."""
    if wide:
        return x.astype(object) * n - total
    low = np.array([s & (2**64 - 1) for s in total.tolist()], np.uint64)
    return (x.astype(np.uint64) * np.uint64(n & (2**64 - 1)) - low).astype(np.int64)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y as limbs of LIMB bits, least first, each a matrix of doubles; the last one has the sign."""
    out = []
    while True:
        if not y.size or np.abs(y).max() < 1 << LIMB:
            return [*out, y.astype(np.float64)]
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b of integers, as big integers: BLAS on limbs, BLOCK rows at a time."""
    out = np.zeros((a.shape[1], b.shape[1]), object)
    for at in range(0, len(a), BLOCK):
        left, right = limbs(a[at : at + BLOCK]), limbs(b[at : at + BLOCK])
        for i, u in enumerate(left):
            for j, v in enumerate(right):
                out += (u.T @ v).astype(np.int64).astype(object) << (LIMB * (i + j))
    return out


def words(values: list[int], k: int) -> np.ndarray:
    """Big integers as k words of WORD bits in longs, least first, the last one with the sign."""
    out = np.empty((k, len(values)), np.int64)
    for w in range(k - 1):
        out[w] = [(v >> (WORD * w)) & ((1 << WORD) - 1) for v in values]
    out[k - 1] = [v >> (WORD * (k - 1)) for v in values]
    return out


def big(row, k: int) -> int:
    return sum(row[f"w{i}"] << (WORD * i) for i in range(k))


def word_columns(k: int) -> str:
    return ", ".join(f"w{i} long" for i in range(k))


def word_sums(k: int) -> list:
    return [F.sum(f"w{i}").alias(f"w{i}") for i in range(k)]


@dataclass
class Whitening:
    """A fitted whitening of vectors of d integers; its size goes with d alone."""

    n: int
    total: np.ndarray  # S, big integers
    wide: bool  # whether n*x - S may pass the bounds of longs
    rank: int  # of the covariance: later components are directions without any spread
    eigenvalues: np.ndarray  # of the components, falling
    components: np.ndarray  # d x m, unit columns
    trace: float

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n*x - S)^2, exactly."""
        y = centred(x, self.n, self.total, self.wide)
        if self.wide or (y.size and y.shape[1] * float(np.abs(y).max()) ** 2 >= 2.0**62):
            y = y.astype(object)
        return (y * y).sum(axis=1).tolist()

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """x - S/n on the components over the root of their eigenvalues; NaN along constant directions."""
        y = centred(x, self.n, self.total, self.wide).astype(np.float64) / self.n
        known = self.known()
        out = np.full((len(x), len(known)), np.nan)
        out[:, known] = y @ self.components[:, known] / np.sqrt(self.eigenvalues[known])
        return out

    def known(self) -> np.ndarray:
        return (np.arange(len(self.eigenvalues)) < self.rank) & (self.eigenvalues > 0)


def rank_of(matrix: np.ndarray) -> int:
    """Rank of a matrix of big integers, by elimination modulo primes (the greater of two, as a prime may hide some)."""
    best = 0
    for p in PRIMES:
        m, rank = (matrix % p).astype(np.uint64), 0
        for col in range(m.shape[1]):
            pivots = np.flatnonzero(m[rank:, col])
            if not len(pivots):
                continue
            m[[rank, rank + pivots[0]]] = m[[rank + pivots[0], rank]]
            m[rank] = m[rank] * np.uint64(pow(int(m[rank, col]), -1, p)) % np.uint64(p)
            factors = m[rank + 1 :, col].copy()
            m[rank + 1 :] = (m[rank + 1 :] + (np.uint64(p) - factors)[:, None] * m[rank] % np.uint64(p)) % np.uint64(p)
            rank += 1
            if rank == len(m):
                break
        best = max(best, rank)
    return best


def eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix of big integers, small eigenvalues too
    to nearly all digits: the matrix is turned into its computed eigenbasis without rounding, and Jacobi rotations finish what
    little stands beside the diagonal."""
    _, q = np.linalg.eigh(cov.astype(np.float64))
    bits = 60
    whole = np.array([[round(float(v) * 2.0**bits) for v in row] for row in q], object)
    turned = product(whole, product(cov, whole))
    b = np.array([[v / (1 << (2 * bits)) for v in row] for row in turned])
    d = len(b)
    for _ in range(30):
        diag = np.sqrt(np.maximum(np.diag(b), 0))
        off = np.abs(b - np.diag(np.diag(b)))
        size = np.maximum(diag, 1e-20 * diag.max(initial=0.0))
        rest = np.argwhere(np.triu(off > 1e-15 * np.outer(size, size), 1))
        if not len(rest):
            break
        for i, j in rest:
            if b[i, j] == 0:
                continue
            theta = (b[j, j] - b[i, i]) / (2 * b[i, j])
            t = (1.0 if theta >= 0 else -1.0) / (abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            bi, bj = b[:, i].copy(), b[:, j].copy()
            b[:, i], b[:, j] = c * bi - s * bj, s * bi + c * bj
            bi, bj = b[i].copy(), b[j].copy()
            b[i], b[j] = c * bi - s * bj, s * bi + c * bj
            b[i, j] = b[j, i] = 0.0
            qi, qj = q[:, i].copy(), q[:, j].copy()
            q[:, i], q[:, j] = c * qi - s * qj, s * qi + c * qj
    e = np.diag(b)
    order = np.argsort(-e, kind="stable")
    q = q[:, order]
    return e[order], q / np.linalg.norm(q, axis=0).reshape(1, d)


def sums(fit: DataFrame) -> tuple[int, np.ndarray, int, int]:
    """n, S, least and greatest entry over fit(x)."""

    def run(batches):
        n, total, low, high = 0, None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            part = x.astype(object).sum(axis=0) if np.abs(x.astype(np.float64)).max() * len(x) >= 2.0**62 else x.sum(axis=0).astype(object)
            low, high = (min(low, int(x.min())), max(high, int(x.max()))) if n else (int(x.min()), int(x.max()))
            n, total = n + len(x), part if total is None else total + part
        if n:
            d = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(d)), pa.array([n] * d), pa.array([low] * d), pa.array([high] * d), *map(pa.array, words(total.tolist(), 4))],
                ["i", "n", "low", "high", "w0", "w1", "w2", "w3"],
            )

    parts = fit.mapInArrow(run, f"i long, n long, low long, high long, {word_columns(4)}")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), *word_sums(4)).orderBy("i").collect()
    if not rows:
        return 0, np.zeros(0, object), 0, 0
    return rows[0]["n"], np.array([big(r, 4) for r in rows], object), min(r["low"] for r in rows), max(r["high"] for r in rows)


def scatter(fit: DataFrame, n: int, total: np.ndarray, wide: bool, k: int) -> np.ndarray:
    """Sum over fit(x) of (n*x - S)(n*x - S)^T, as big integers of at most k words."""
    d = len(total)
    upper = np.triu_indices(d)

    def run(batches):
        held = np.zeros((d, d), object)
        for batch in batches:
            if batch.num_rows:
                y = centred(matrix(batch.column("x")), n, total, wide)
                held += product(y, y)
        if held.any():
            cells = words(held[upper].tolist(), k)
            yield pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), *map(pa.array, cells)], ["i", "j", *[f"w{i}" for i in range(k)]])

    out = np.zeros((d, d), object)
    found = fit.mapInArrow(run, f"i long, j long, {word_columns(k)}").groupBy("i", "j").agg(*word_sums(k))
    for r in found.toLocalIterator():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = big(r, k)
    return out


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """Each x once, as a table."""
    return written(rows.select("x").distinct(), "vectors")


def fit_whitening(fit: DataFrame, most: int = 16) -> Whitening:
    """The whitening of fit(x), whose rows each count once. Components: the first `most`, or as many as there are dimensions."""
    n, total, low, high = sums(fit)
    if not n:
        return Whitening(0, total, False, 0, np.zeros(0), np.zeros((0, 0)), 0.0)
    reach = n * (high - low)
    wide = reach >= 1 << 62
    cov = scatter(fit, n, total, wide, (n * reach * reach).bit_length() // WORD + 2)
    e, q = eigen(cov)
    trace = sum(int(v) for v in cov.diagonal())
    cube = n**3  # V = cov / n^3
    m = min(most, len(total))
    values = np.array([v / float(cube) for v in e[:m]])
    return Whitening(n, total, wide, rank_of(cov), np.maximum(values, 0.0), q[:, :m], trace / cube)


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components that vary."""
    known = model.known()
    m = int(known.sum())
    if not m:
        return None
    upper = np.triu_indices(m)

    def run(batches):
        held, seen = np.zeros((m, m)), 0
        for batch in batches:
            if batch.num_rows:
                w = model.whiten(matrix(batch.column("x")))[:, known]
                held, seen = held + w.T @ w, seen + len(w)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(upper[0]), pa.array(upper[1]), pa.array(held[upper])], ["i", "j", "v"])

    cells = fit.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    gap = F.abs(F.col("v") / model.n - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return cells.agg(F.max(gap)).first()[0]


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """rows(vec_id, x) -> vec_id, component (from 1), deviation (decimal text), whitened, explained: a row for each component.
    Along directions in which no vector differs whitened is null."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    m = len(model.eigenvalues)
    explained = model.eigenvalues / model.trace if model.trace else np.full(m, np.nan)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            w = model.whiten(x).ravel()
            each = np.repeat(np.arange(len(x)), m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                    pa.array([str(v) for v in model.deviation(x)]).take(pa.array(each)),
                    pa.array(w, mask=np.isnan(w)),
                    pa.array(np.tile(explained, len(x)), mask=np.tile(np.isnan(explained), len(x))),
                ],
                ["vec_id", "component", "deviation", "whitened", "explained"],
            )

    return rows.mapInArrow(run, f"vec_id {kind}, component int, deviation string, whitened double, explained double")


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row of embeddings that has a whole vector.

    Null ids and repeated rows stay, each with its own rows; other columns are ignored; an empty table gives none. Where all
    vectors are equal, or in directions without any spread, whitened is null. A deviation beyond a long's range is null
    here (the operator gives it as a text of digits)."""
    rows = vectors(table(spark, sf_dir, "embeddings"))
    fit = distinct_vectors(rows)
    model = fit_whitening(fit)
    error = identity_error(fit, model) if model.n else None
    unwritten(fit)
    return whitened(rows, model).select(
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation as long)").alias("deviation"), "whitened", "explained", F.lit(error).cast("double").alias("identity_error")
    )
