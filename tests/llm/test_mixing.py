import pytest
from pyspark.sql import functions as F

from strataprobe.llm.mixing import mix, source_targets

from .helpers import WHITE, corpus, frame


def filled(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by resharing step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 40, None: 7}, {"a": 1, "b": 1000}, {"x": 10}, {"a": 0, "b": 9}, {"é": 30, "z": 50, "Z": 2}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert got == pytest.approx(filled(sizes))


@pytest.mark.parametrize("whole", [False, True])
def test_mix(spark, whole):
    rows = corpus()
    out = mix(frame(spark, rows), whole=whole).collect()
    assert len(out) == len(rows)
    size = lambda t: len(WHITE.findall(t or ""))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in out) == sorted((d is None, d or 0, size(t)) for d, t, _, _ in rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    targets = filled(sizes)
    for s in sizes:
        mine = [r for r in out if r["source"] == s]
        taken = sum(r["taken"] for r in mine)
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s]) for r in mine)
        assert abs(taken - targets[s]) <= (max(r["size"] for r in mine) if whole else 1)
        epochs = int(round(targets[s])) // sizes[s] if sizes[s] else 0
        for r in mine:
            assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] >= epochs * r["size"]
            assert not whole or not r["size"] or r["taken"] % r["size"] == 0
        # those taken once more are those of the least keys
        order = sorted(mine, key=lambda r: (r["sample_key"], r["doc_id"] is not None, r["doc_id"] or 0, r["size"]))
        extra = [r["taken"] - epochs * r["size"] for r in order if r["size"]]
        assert extra == sorted(extra, key=lambda e: e == 0) or all(e == 0 for e in extra) or whole


def test_reruns_and_partitions_agree(spark):
    rows = corpus()
    a = mix(frame(spark, rows)).select("doc_id", "size", "taken").orderBy("doc_id", "size").collect()
    b = mix(frame(spark, list(reversed(rows))).repartition(2)).select("doc_id", "size", "taken").orderBy("doc_id", "size").collect()
    assert a == b


def test_better_quality_is_taken_more_often(spark):
    rows = [(i, ("words of letters " if i % 2 else "1 2 3 4 ##### ") * 6, "en", "a" if i < 400 else "b") for i in range(500)]
    out = mix(frame(spark, rows, clash=False), weights=(1, 30), cap=2.0).where("source = 'a'")
    share = out.groupBy((F.col("doc_id") % 2).alias("good")).agg((F.sum("taken") / F.sum("size")).alias("x")).collect()
    by = {r["good"]: r["x"] for r in share}
    assert by[1] > by[0]


@pytest.mark.parametrize("text", ["12345 678", "words of letters"])
def test_no_bucket_holds_a_source(spark, text, monkeypatch):
    """A source of one quality, however low: its windows stay small."""
    from strataprobe.llm import mixing

    cuts = []
    monkeypatch.setattr(mixing, "written", lambda df, name: cuts.append(df) or df)
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.lit("one").alias("source"))
    mix(docs)
    sizes = cuts[1]  # bucket sums
    assert sizes.agg((F.max("bucket_size") / F.sum("bucket_size")).alias("x")).first()["x"] < 0.01


def test_given_qualities(spark):
    rows = [(i, "words of letters", "en", "a" if i < 400 else "b") for i in range(500)] + [(500, "one more", "en", "b"), (501, None, "en", "b")]
    q = F.when(F.col("doc_id") % 2 == 0, 0.9).when(F.col("doc_id") < 500, 0.05)
    out = mix(frame(spark, rows, clash=False), weights=(1, 30), quality=q)
    assert out.count() == 502
    by = {r["good"]: r["x"] for r in out.where("source = 'a'").groupBy((F.col("doc_id") % 2 == 0).alias("good")).agg(F.sum("taken").alias("x")).collect()}
    assert by[True] - 600 > 5 * (by[False] - 600)  # 600 words each by the whole epoch


def test_empty(spark):
    assert mix(frame(spark, corpus()).where("false")).count() == 0
