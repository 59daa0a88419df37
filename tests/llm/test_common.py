import random

from strataprobe.llm.common import ascii_lower, components, shared_dir, written

from .helpers import union_find


def test_components_against_union_find(spark):
    rng = random.Random(3)
    for n, m in ((40, 30), (60, 80)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n, n + 30)] + [(n + 50, n + 51 + i) for i in range(40)]
        top = n + 100
        df = spark.createDataFrame([*links, (5, 5), (None, 3)], "src long, dst long")
        got = {r["node"]: r["component"] for r in components(df).collect()}
        want = union_find(top, links)
        touched = {x for a, b in links if a != b for x in (a, b)}
        assert got == {x: want[x] for x in touched}


def test_hubs_are_dealt_out(spark, monkeypatch):
    from strataprobe.llm import common

    monkeypatch.setattr(common, "HUB_EDGES", 7)
    links = [(0, i) for i in range(1, 60)] + [(100, 61 + i) for i in range(30)] + [(59, 61), (200, 201)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {x: 200 if x >= 200 else 0 for a, b in links for x in (a, b)}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_written_survives_and_uses_the_shared_folder(spark):
    df = written(spark.range(10))
    assert df.count() == 10 and df.scratch.startswith(shared_dir(spark))


def test_settings_come_back_after_threads(spark):
    from concurrent.futures import ThreadPoolExecutor

    from strataprobe.llm.common import CUT_CONF

    before = {k: spark.conf.get(k, None) for k in CUT_CONF}
    with ThreadPoolExecutor(4) as pool:
        assert sum(pool.map(lambda i: written(spark.range(i)).rows, range(12))) == 66
    assert {k: spark.conf.get(k, None) for k in CUT_CONF} == before


def test_large_cuts_are_not_broadcast(spark):
    big, small = written(spark.range(2_000_000).selectExpr("id", "id % 3 as k")), written(spark.range(3))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan(spark.range(9).join(big, "id")) and "strategy" not in plan(spark.range(9).join(small, "id"))


def test_a_cluster_needs_its_shared_folder():
    import pytest

    from strataprobe.llm import common

    class Part:
        master = "spark://host:7077"

        def get(self, *a):
            return None

        def getCheckpointDir(self):
            return None

    class Session:
        conf = sparkContext = Part()

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_ascii_lower(spark):
    df = spark.createDataFrame([("ABC É İ",), ("AbC",)], "t string")
    assert [r[0] for r in df.select(ascii_lower(df["t"])).collect()] == ["abc É İ", "abc"]


def test_ids_that_are_texts(spark):
    from strataprobe.llm import fingerprint, jaccard, quality

    text = "the same ten words stand in both of these rows here"
    df = spark.createDataFrame([("a", text), ("b", text), ("7", "other words"), (None, "")], "doc_id string, text string")
    got = {(r["doc_id"], r["n_shingles"], r["n_members"]) for r in jaccard.jaccard_components(df).collect()}
    assert got == {(None, 8, 2), (7, 1, 1), (None, 0, 1)}
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(df).collect()}
    assert set(prints) == {"a", "b", "7", None} and prints["a"] == prints["b"]
    labels = spark.createDataFrame([("a", 1), ("7", 0)], "doc_id string, quality int")
    assert quality.fit_quality(df, labels).coef.any()
