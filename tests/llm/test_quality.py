import random
import zlib

import numpy as np
import pytest

from strataprobe.llm import quality as q

from .helpers import corpus, frame, prose


def labelled(seed=4, n=300):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, 80, 3000) if good else rng.choice(["buy now!!! ", "| x | y ", "zz zz "]) * rng.randrange(5, 60)
        rows.append((i, text, "en", "s"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark, tmp_path):
    rows, labels = labelled()
    frame(spark, rows + [(9001, None, None, None), (9002, "", "en", "s")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels + [(5, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in q.op9_quality(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + 2
    held = [i for i in range(len(rows)) if got[i]["held_out"]]
    assert held == [i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [got[i]["predicted"] == labels[i][1] for i in held]
    assert sum(right) / len(right) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert got[9001]["score"] == got[9002]["score"]


def test_only_training_labels_matter(spark):
    rows, labels = labelled(n=120)
    df = frame(spark, rows)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, t) for i, y, t in labels]
    schema = "doc_id long, quality int, toxic int"
    fits = [q.fit_quality(df, q.training_labels(spark.createDataFrame(x, schema))) for x in (labels, flipped)]
    assert np.allclose(fits[0].coef, fits[1].coef)


def test_partition_sums_match_one_fit(spark):
    rows, labels = labelled(n=80)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a = q.fit_quality(frame(spark, rows).repartition(1), lab)
    b = q.fit_quality(frame(spark, rows).repartition(7), lab)
    stats = np.array([q.text_stats(t.encode()) for _, t, _, _ in rows])
    x, y = a.lift(stats), np.array([v for _, v, _ in labels], float)
    gram = x.T @ x
    direct = np.linalg.solve(gram + 1e-3 * max(1.0, np.trace(gram) / len(gram)) * np.eye(len(gram)), x.T @ y)
    assert np.allclose(a.coef, b.coef, atol=1e-6) and np.allclose(a.coef, direct, atol=1e-6)


def test_isotonic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * x))).astype(float)
    knots, levels = q.pool_adjacent(x, y)
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) >= 0).all() and levels.min() >= 0 and levels.max() <= 1
    assert abs(np.interp(x, knots, levels).mean() - y.mean()) < 0.05


def test_kernel_is_approximated():
    rng = np.random.default_rng(2)
    stats = rng.normal(size=(60, q.STATS))
    freq, phase = rng.normal(size=(q.STATS, 4096)) / 4.0, rng.uniform(0, 2 * np.pi, 4096)
    m = q.QualityModel(np.zeros(q.STATS), np.ones(q.STATS), freq, phase, np.zeros(4096 + q.STATS + 1))
    wave = m.lift(stats)[:, :4096]
    d2 = ((stats[:, None] - stats[None]) ** 2).sum(-1)
    assert np.abs(wave @ wave.T - np.exp(-d2 / 32)).max() < 0.12


def test_statistics():
    s = q.text_stats("aa bb aa!\naa".encode())
    assert s[11] == pytest.approx(2.25) and s[13] == pytest.approx(3 / 4)
    for raw in (b"", b" \n\t", b"\xff\xfe", b"x" * 100_000):
        assert np.isfinite(q.text_stats(raw)).all()


def test_no_labels_and_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    df = frame(spark, corpus())
    model = q.fit_quality(df, none)
    assert {r[0] for r in df.select(q.score_udf(model)(df["text"])).collect()} == {0.5}
    assert q.fit_quality(df.where("false"), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).levels.tolist() == [0.5, 0.5]
