import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataprobe.llm import whitening as w


def ints(v):
    return tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)


def plain(rows, most=16):
    """The contract in fractions: rows (id, vector) -> n, S, V, kept."""
    kept = [(i, ints(v)) for i, v in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in kept})
    n, d = len(fit), len(fit[0])
    total = [sum(x[k] for x in fit) for k in range(d)]
    cov = [[sum(Fraction(n * x[i] - total[i]) * (n * x[j] - total[j]) for x in fit) / n**3 for j in range(d)] for i in range(d)]
    return kept, fit, n, total, cov


def made(seed=3, n=400, d=9, spread=1.0):
    rng = random.Random(seed)
    mix = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(d)]
    rows = []
    for i in range(n):
        z = [rng.gauss(0, spread * 2.0 ** (-k)) for k in range(d)]
        rows.append((i, [float(np.float32(sum(a * b for a, b in zip(z, m)))) for m in mix]))
    return rows


def put(spark, tmp_path, rows, kind="array<float>"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}")
    df = df.select("*", F.lit(1).alias("label"), F.lit("a").alias("x"), F.lit(2).alias("component"), F.lit(0.5).alias("n"))
    df.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")


@pytest.mark.parametrize("spread", [0.2, 3.0, 1e6])
def test_query_against_fractions(spark, tmp_path, spread):
    rows = made(spread=spread)
    rows += [(1000, rows[0][1]), (1000, rows[0][1]), (None, rows[1][1]), (1001, None), (1002, [1.0] * 8 + [None]), (1003, [1.0] * 8 + [math.nan]), (1004, [math.inf] * 9), (1005, [])]
    put(spark, tmp_path, rows)
    got = w.op11_whitening(spark, str(tmp_path))
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["n"] == "bigint"
    got = got.collect()
    kept, fit, n, total, cov = plain(rows)
    d = len(total)
    assert len(got) == len(kept) * d
    assert {r["n"] for r in got} == {n}
    want = {}
    for i, x in kept:
        want.setdefault(i, []).append(sum((n * a - s) ** 2 for a, s in zip(x, total)))
    for r in got:
        exact = want[r["vec_id"]][0]
        assert r["deviation"] == (exact if exact < 2**63 else None)
    trace = float(sum(cov[k][k] for k in range(d)))
    e = {r["component"]: r["explained"] * trace for r in got}
    assert [e[k] for k in range(1, d + 1)] == sorted(e.values(), reverse=True)
    assert math.isclose(sum(e.values()), trace, rel_tol=1e-9)
    assert {r["identity_error"] for r in got} and max(r["identity_error"] for r in got) < 1e-8
    # whitened rows of the fit list, centred before multiplying, have the identity as covariance
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    seen, white, left = set(), [], []
    for i, x in kept:
        if x not in seen:
            seen.add(x)
            white.append([by[i][k] for k in range(1, d + 1)])
            left.append([float(Fraction(a) - Fraction(s, n)) for a, s in zip(x, total)])
    white, left = np.array(white), np.array(left)
    assert np.allclose(white.T @ white / n, np.eye(d), atol=1e-7)
    # and give the vectors back: a rotation and a scale, nothing else
    basis = (left.T @ white / n) / np.sqrt([e[k] for k in range(1, d + 1)])
    assert np.allclose(basis.T @ basis, np.eye(d), atol=1e-7)
    v = np.array([[float(c) for c in row] for row in cov])
    assert np.allclose(v @ basis, basis * [e[k] for k in range(1, d + 1)], atol=1e-7 * trace)


def test_badly_scaled_dimensions_keep_their_digits():
    rng = random.Random(5)
    scales = [10**9, 10**7, 1000, 3, 1]
    mix = np.array([[rng.randrange(-3, 4) for _ in range(5)] for _ in range(300)], object)
    x = mix * np.array(scales, object) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    y = x * n - total
    cov = w.product(y, y)
    assert (cov == y.T.dot(y)).all()
    e, q = w.eigen(cov)
    assert w.rank_of(cov) == 5
    k = w.Whitening(n, total, True, 5, e / float(n**3), q, 1.0)
    got = k.whiten(x)
    assert np.allclose(got.T @ got / n, np.eye(5), atol=1e-9)


def test_limbs_are_exact_for_wide_integers():
    rng = random.Random(6)
    a = np.array([[rng.randrange(-(2**90), 2**90) for _ in range(4)] for _ in range(50)], object)
    assert (w.product(a, a) == a.T.dot(a)).all()
    b = np.array([[rng.randrange(-(2**61), 2**61) for _ in range(3)] for _ in range(20_000)], np.int64)
    assert (w.product(b, b) == b.astype(object).T.dot(b.astype(object))).all()
    values = [rng.randrange(-(2**100), 2**100) for _ in range(30)] + [0, -1, 1]
    assert [w.big({f"w{i}": int(c) for i, c in enumerate(col)}, 5) for col in w.words(values, 5).T] == values


def test_values_past_longs(spark, tmp_path):
    rows = [(i, [1e300 if i % 2 else -1e300, float(i)]) for i in range(20)]
    put(spark, tmp_path, rows, "array<double>")
    got = w.op11_whitening(spark, str(tmp_path)).collect()
    assert len(got) == 40 and all(r["deviation"] is None and math.isfinite(r["whitened"]) for r in got)
    assert got[0]["identity_error"] < 1e-6


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, []), (2, None)]])
def test_nothing_to_fit(spark, tmp_path, rows):
    put(spark, tmp_path, rows)
    assert w.op11_whitening(spark, str(tmp_path)).collect() == []


def test_no_spread_and_flat_directions(spark, tmp_path):
    put(spark, tmp_path, [(i, [0.25, 1.0]) for i in range(4)])
    got = w.op11_whitening(spark, str(tmp_path)).collect()
    assert len(got) == 8 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["n"] == 1 and r["identity_error"] is None for r in got)


def test_flat_direction_beside_others(spark, tmp_path):
    put(spark, tmp_path, [(i, [0.25, i / 8, -i / 4, (i * i) / 2]) for i in range(30)] + [(99, [1.0, 2.0])])
    got = w.op11_whitening(spark, str(tmp_path)).collect()
    assert len(got) == 120  # the row of another length is dropped
    assert {r["component"] for r in got if r["whitened"] is None} == {3, 4}
    assert got[0]["identity_error"] < 1e-9


def test_same_fit_for_any_partitions(spark, tmp_path):
    rows = made(n=200)
    put(spark, tmp_path, rows)
    df = w.vectors(spark.read.parquet(f"{tmp_path}/embeddings.parquet"))
    a, b = (w.fit_whitening(w.distinct_vectors(df.repartition(k))) for k in (1, 7))
    assert a.n == b.n and (a.total == b.total).all() and (a.eigenvalues == b.eigenvalues).all() and (a.components == b.components).all()
