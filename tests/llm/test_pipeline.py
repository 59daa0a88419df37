"""The pipeline's stages against plain versions, each on the input it gets."""

import random

import corpus_pipeline as cp

from strataprobe.llm import quality as q

from .helpers import WHITE, corpus, frame, prose
from .test_decontaminate import plain as hits
from .test_jaccard import plain as groups


def case(spark, tmp_path):
    rng = random.Random(12)
    rows = [r for r in corpus(7, 80) if len(r[1] or "") < 20_000]
    bench = [(i, prose(rng, 25, 4000)) for i in range(5)]
    rows += [(4000 + i, prose(rng, 40, 5000) + " " + bench[i % 5][1] + " " + prose(rng, 9, 5000), "en", f"s{i % 3}") for i in range(12)]
    rows += [(5000 + i, "| x | y " * rng.randrange(9, 50), "en", "s1") for i in range(30)]
    labels = [(d, 0 if (t or "").startswith("| x") else 1, 0) for d, t, _, _ in rows if d is not None]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, bench


def as_rows(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def key(rows):
    return sorted(rows, key=str)


def test_stages(spark, tmp_path):
    rows, bench = case(spark, tmp_path)
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(cp.STAGES):
        before = as_rows(docs)
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns if k < 4 else set(columns) <= set(out.columns)
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        after = as_rows(docs)
        if k == 0:
            labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
            model = q.fit_quality(spark.read.parquet(f"{tmp_path}/documents.parquet"), q.training_labels(labels).select("doc_id", "quality"))
            import numpy as np

            kept = [r for r in before if model.score(np.array([q.text_stats((r[1] or "").encode())]))[0] >= 0.3]
            assert key(after) == key(kept) and not any((t or "").startswith("| x") for _, t, _, _ in after)
        elif k == 1:
            assert key(after) == key(kept_rows(before))
        elif k == 2:
            bad = {(a, b) for a, b, _, _, _, _, hit in hits(before, bench) if hit}
            assert key(after) == key([r for r in before if (r[0] is None, r[0] or 0) not in bad]) and not any(d in range(4000, 4012) for d, *_ in after if d)
        elif k == 3:
            assert set(after) <= set(before) and all(after.count(r) <= 2 for r in set(after))
            words = lambda rs, s: sum(len(WHITE.findall(t or "")) for _, t, _, src in rs if src == s)
            total = sum(words(before, s) for s in {r[3] for r in before})
            assert abs(sum(words(after, s) for s in {r[3] for r in after}) / total - 1.5) < 0.15
        else:
            assert key(after) == key(before) and docs.where("shard_id is null").count() == 0


def kept_rows(rows):
    """One row of each group: that of the smallest id, null ids last."""
    by_group = {}
    for row, (_, n, c) in zip(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), groups(rows, 5, 80), strict=True):
        by_group.setdefault((c,) if n else ("alone", id(row)), row)
    return list(by_group.values())


def test_repeated_ids_lose_no_text(spark, tmp_path):
    a, b, c, d = (prose(random.Random(i), 30, 900) for i in range(4))
    rows = [(1, a, "en", "s"), (5, a, "en", "s"), (5, b, "en", "s"), (6, c, "en", "s"), (6, d, "en", "t"), (6, d, "en", "t"), (7, b, "en", "s"), (None, c, "en", "s"), (None, "", "en", "s"), (8, "", "en", "s"), (8, "", "en", "s")]
    got = as_rows(cp.near_duplicates(spark, frame(spark, rows), str(tmp_path)))
    assert key(got) == key([rows[0], rows[2], rows[3], rows[4], rows[8], rows[9], rows[10]])


def test_output_is_where_it_is_asked_for(spark, tmp_path):
    from strataprobe.llm.shards import ShardStore

    case(spark, tmp_path)
    n = cp.run(spark, str(tmp_path), output=f"file://{tmp_path}/out").count()
    assert n > 0 and ShardStore(spark, f"file://{tmp_path}/out").read().count() == n


def test_run_and_empty(spark, tmp_path):
    case(spark, tmp_path)
    assert cp.run(spark, str(tmp_path)).count() > 0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
