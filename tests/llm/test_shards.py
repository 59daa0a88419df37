import pytest

from strataprobe.llm.shards import ConflictError, ShardStore, shard

from .helpers import corpus, frame


def store(spark, tmp_path, **how):
    return ShardStore(spark, f"file://{tmp_path}/store", **how)


def test_append_compact_read(spark, tmp_path):
    s = store(spark, tmp_path, target_bytes=40_000, fanout=4)
    parts = [frame(spark, corpus(k, 30), clash=False) for k in range(4)]
    for p in parts:
        s.append(p)
    n = s.files().count()
    old = s.versions()[-1]
    before = sorted(map(str, s.read().drop("shard_id", "shard_version").collect()))
    version = s.compact()
    assert version > old and s.files().count() < n
    assert sorted(map(str, s.read().drop("shard_id", "shard_version").collect())) == before == sorted(str(r) for p in parts for r in p.collect())
    assert sorted(map(str, s.read(old).drop("shard_id", "shard_version").collect())) == before  # the old version still reads
    assert s.files().selectExpr("max(bytes)").first()[0] < 3 * s.target_bytes
    counts = {r["shard_id"]: r["count"] for r in s.read().groupBy("shard_id").count().collect()}
    assert len(counts) == s.files().count() and sum(counts.values()) == s.files().selectExpr("sum(rows)").first()[0]
    assert s.vacuum() == 0  # all of it is young
    assert s.vacuum(keep_versions=1, min_age_s=0) >= n  # merged arrivals and what passes in between left
    with pytest.raises(LookupError):
        s.read(old)
    assert sorted(map(str, s.read().drop("shard_id", "shard_version").collect())) == before
    assert s.compact() == version  # nothing left to merge


def others_first(store, monkeypatch, act):
    """Before the next commit, another writer has its turn."""
    commit, turns = ShardStore._commit, [act]

    def late(self, *args):
        if turns:
            turns.pop()()
        return commit(self, *args)

    monkeypatch.setattr(ShardStore, "_commit", late)


def test_a_vacuum_during_an_append(spark, tmp_path, monkeypatch):
    s, other = store(spark, tmp_path), store(spark, tmp_path)
    s.append(spark.range(10))
    others_first(s, monkeypatch, other.vacuum)
    s.append(spark.range(10, 20))
    assert sorted(r["id"] for r in s.read().collect()) == list(range(20))


def test_two_appends_at_once(spark, tmp_path, monkeypatch):
    s, other = store(spark, tmp_path), store(spark, tmp_path)
    s.append(spark.range(10))
    others_first(s, monkeypatch, lambda: other.append(spark.range(10, 15)))
    assert s.append(spark.range(15, 20)) == 3
    assert sorted(r["id"] for r in s.read().collect()) == list(range(20))


@pytest.mark.parametrize("rival", ["append", "compact"])
def test_a_compaction_meets_another_writer(spark, tmp_path, monkeypatch, rival):
    s, other = store(spark, tmp_path), store(spark, tmp_path)
    for i in range(3):
        s.append(spark.range(10 * i, 10 * i + 10))
    others_first(s, monkeypatch, other.compact if rival == "compact" else lambda: other.append(spark.range(30, 40)))
    s.compact()
    assert sorted(r["id"] for r in s.read().collect()) == list(range(30 if rival == "compact" else 40))
    assert sorted(r["id"] for r in s.read(3).collect()) == list(range(30))


def test_old_versions_outlive_a_vacuum(spark, tmp_path):
    s = store(spark, tmp_path)
    for i in range(4):
        s.append(spark.range(10 * i, 10 * i + 10))
    s.compact()
    s.vacuum(keep_versions=3, min_age_s=0)
    assert s.versions() == [3, 4, 5]
    assert [s.read(v).count() for v in s.versions()] == [30, 40, 40]
    with pytest.raises(LookupError):
        s.read(1)


def test_empty_and_null_rows(spark, tmp_path):
    s = store(spark, tmp_path)
    with pytest.raises(LookupError):
        s.read()
    assert s.compact() == 0 and s.vacuum() == 0
    s.append(spark.createDataFrame([], "a long, b string"))
    s.append(spark.createDataFrame([(None, None), (None, None), (1, "")], "a long, b string"))
    s.append(spark.createDataFrame([("x" * 300_000, 2)], "b string, a long"))  # by name
    s.compact()
    assert sorted((str(r["a"]), len(r["b"] or "")) for r in s.read().collect()) == [("1", 0), ("2", 300_000), ("None", 0), ("None", 0)]


def test_query_against_plain_sums(spark, tmp_path):
    """op7_shard: the documents' rows and bytes, once each, and a file for each shard id that the manifest names."""
    from strataprobe.llm.shards import op7_shard

    rows = corpus()
    frame(spark, rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = op7_shard(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"] or -1) for r in got) == sorted((str(d), len(t.encode()) or -1 if t is not None else -1) for d, t, _, _ in rows)
    assert len({r["shard_version"] for r in got}) == 1 and all(r["shard_id"] for r in got)


def test_tiers(spark, tmp_path):
    s = store(spark, tmp_path, target_bytes=1024, fanout=4)
    assert [s.tier(x) for x in (2000, 512, 511, 256, 64, 16, 0)] == [0, 0, 1, 1, 2, 3, 5]


def test_a_version_is_committed_once(spark, tmp_path):
    s = store(spark, tmp_path)
    df = spark.range(5)
    s.append(df)
    head, files = s.head(), s.files()
    s.append(df)
    with pytest.raises(ConflictError):
        s._commit(files, df.schema, head["version"])
    assert s.versions() == [1, 2] and s.read().count() == 10


def test_every_row_and_column_comes_back(spark, tmp_path):
    df = frame(spark, corpus())  # with columns shard_id and part among others
    got = shard(df, f"file://{tmp_path}/s")
    assert got.count() == df.count() and set(df.columns) <= set(got.columns)
    keep = [c for c in df.columns if c != "shard_id"]
    assert sorted(map(str, got.select(keep).collect())) == sorted(map(str, df.select(keep).collect()))
    assert got.select("shard_version").distinct().count() == 1


def test_empty(spark, tmp_path):
    df = frame(spark, corpus()).where("false")
    assert shard(df, f"file://{tmp_path}/e").count() == 0
