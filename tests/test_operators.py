import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataprobe.operators import changes, graphs, inventory, search, timeline


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_numbered_lines(spark):
    df = spark.createDataFrame([("a", "x\r\ny\rz\n"), ("b", ""), ("c", "p\n\nq")], "path string, text string")
    assert rows(search.numbered_lines(df, "path", "text"), "path", "line_no", "line") == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "z"), ("c", 1, "p"), ("c", 2, ""), ("c", 3, "q")]


def test_search_counts_and_samples(spark):
    lines = spark.createDataFrame([("f", i, "aa aa" if i % 2 else "b AA") for i in range(1, 9)], "path string, line_no int, line string")
    m = search.line_matches(lines, ["aa", "zz", "aa"])
    assert rows(search.match_counts(m), "identifier", "match_count", "matching_lines", "first_line", "last_line") == [("aa", 8, 4, 1, 7)]
    assert rows(search.match_samples(m, 2), "line_no") == [(1,), (3,)]
    folded = search.match_counts(search.line_matches(lines, ["AA"], ignore_case=True))
    assert rows(folded, "match_count") == [(12,)]
    try:
        search.line_matches(lines, [""])
    except ValueError:
        pass
    else:
        raise AssertionError("an empty identifier was let in")


def test_merge_rules(spark):
    r = spark.createDataFrame([("i", 1, "0000", "f", "old", "a"), ("i", 2, "0001", "g", "", "0"), ("i", 3, "0002", "f", None, None)], "id string, seq int, interval_id string, source_file string, x string, y string")
    got = changes.merge_by_id(r, ["x", "y"]).first()
    assert (got["x"], got["y"], got["first_seen_interval"], got["last_seen_interval"], got["sources"]) == ("old", "0", "0000", "0002", ["f", "g"])
    base = spark.createDataFrame([("i", "", "kept")], "id string, x string, y string")
    filled = changes.fill_missing(base, r, ["x", "y"]).first()
    assert (filled["x"], filled["y"]) == ("old", "kept")


def test_differences(spark):
    r = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (2, 1, "z")], "k int, o int, v string")
    got = rows(changes.differences(r, ["k"], ["o"], {"v": "value"}), "k", "o", "first", "changes")
    assert got == [(1, 1, True, ""), (1, 2, False, ""), (1, 3, False, "value: 'a' -> None"), (2, 1, True, "")]


def test_gaps(spark):
    ids = spark.createDataFrame([("g", "0000"), ("g", "0001"), ("g", "0004"), ("g", "x")], "g string, id string")
    assert rows(inventory.padded_gaps(ids, ["g"], "id"), "missing") == [("0002",), ("0003",)]


def test_bounded_lines(spark):
    lines = spark.createDataFrame([("f", i, "abcd") for i in range(1, 6)], "path string, line_no int, line string")
    assert inventory.bounded_lines(lines, max_bytes=11).count() == 3
    assert inventory.bounded_lines(lines, max_lines=2).count() == 2


def test_log_dedupe_is_idempotent(spark):
    line = "2026-08-14T10:18:20.500-0700 [INFO] restarting"
    hits = timeline.matching_log_lines(spark.createDataFrame([("s/m.log", "server", 4, line), ("c/m.log", "client", 2, line), ("c/m.log", "client", 3, "x GET /v1/agent/host")], "path string, side string, line_no int, line string"), [])
    assert hits.where("noise").count() == 1
    got = timeline.correlated_log_events(hits.where("not noise"), []).first()
    assert (got["source_type"], got["source_file"], got["source_group"], got["source_line"]) == ("correlated_monitor_log", "c/m.log + s/m.log", "client,server", None)


def test_collapsed_view(spark):
    def row(second, kind, details):
        return (f"2026-08-14 10:00:{second:02d}", kind, f"f{second}", None, "node", "n", "node observed", details, "medium", "")

    df = spark.createDataFrame([row(1, "interval_snapshot", "in interval 0001"), row(2, "interval_snapshot", "in interval 0002"), row(3, "event_stream", "x"), row(4, "interval_snapshot", "in interval 0003")], "ts string, source_type string, source_file string, source_line int, object_type string, object_id string, event string, details string, relevance string, source_group string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = timeline.collapsed_view(df).collect()
    assert [r["source_file"] for r in got] == ["f1 … f2", "f3", "f4"]
    assert "unchanged across 2" in got[0]["details"]
    many = df.sparkSession.range(50_000).selectExpr("timestamp_seconds(1e9 + id) AS ts", "'interval_snapshot' AS source_type", "cast(id as string) AS source_file", "cast(null as int) AS source_line", "'node' AS object_type", "'n' AS object_id", "'e' AS event", "concat('state ', id div 10000, ' interval ', lpad(id % 10000, 4, '0')) AS details", "'' AS relevance", "'' AS source_group")
    whole = timeline.collapsed_view(many).collect()
    assert [r["source_file"] for r in whole] == [f"{i * 10_000} … {i * 10_000 + 9999}" for i in range(5)] and [r["ordinal"] for r in whole] == list(range(5))


def edges(spark, pairs):
    return spark.createDataFrame(pairs or [("", "")], "src string, dst string").where("src <> ''")


def test_hops_any_order(spark):
    pairs = [("a", "b"), ("b", "c"), ("b", "d"), ("x", "y"), ("d", "a")]
    want = None
    for _ in range(2):
        random.shuffle(pairs)
        got = rows(graphs.hops_from(edges(spark, pairs), spark.createDataFrame([("c",)], "node string")), "node", "depth")
        assert want in (None, got)
        want = got
    assert want == [("a", 2), ("b", 1), ("c", 0), ("d", 2)]


def test_walks():
    s = {"a": ["b"], "b": ["c", "d"], "c": [], "d": ["e"], "e": []}
    assert graphs.root_paths(s) == [["a", "b", "c"], ["a", "b", "d", "e"]]
    assert graphs.cycles(s) == []
    ring = {"x": ["y"], "y": ["x"]}
    assert graphs.cycles(ring) == [["x", "y", "x"]]
    assert graphs.root_paths(ring) == [["x", "y", "x"], ["y", "x", "y"]]


def every_cycle(s):
    """Each cycle without a node met twice, from its least node on."""
    out = set()

    def go(path):
        for n in s[path[-1]]:
            if n == path[0]:
                out.add((*path, n))
            elif n > path[0] and n not in path:
                go([*path, n])

    for n in s:
        go([n])
    return sorted(out)


def test_walks_over_a_whole_graph(spark):
    rng = random.Random(4)
    chains = [(f"{c}-{t}", f"{c}-{t + 1}") for c in range(70) for t in range(c % 5 + 1)] + [(f"long-{t:03}", f"long-{t + 1:03}") for t in range(90)]
    rings = [(f"r{c}-{t}", f"r{c}-{(t + 1) % c}") for c in (1, 2, 3, 8) for t in range(c)] + [("ring-tail", "r3-1")]
    cases = [chains, chains + rings, rings, [("x", "y"), ("y", "x")]]
    cases += [[(str(rng.randrange(9)), str(rng.randrange(9))) for _ in range(n)] for n in (6, 9, 12)]
    for pairs in cases:
        s: dict[str, list[str]] = {}
        for a, b in sorted(set(pairs)):
            s.setdefault(a, []).append(b)
            s.setdefault(b, [])
        got = [r["nodes"] for r in graphs.all_root_paths(edges(spark, pairs)).collect()]
        assert sorted(got) == sorted(graphs.root_paths(s, most=10**9))
        got = [tuple(r["nodes"]) for r in graphs.all_cycles(edges(spark, pairs)).collect()]
        assert sorted(got) == every_cycle(s) and {tuple(c) for c in graphs.cycles(s)} <= set(got)
    alone = spark.createDataFrame([("a",), ("only",)], "node string")
    assert rows(graphs.all_root_paths(edges(spark, [("a", "b")]), alone), "nodes") == [(["a", "b"],), (["only"],)]


def test_paths_and_cycles_take_every_conversation(spark, tmp_path):
    from strataprobe.plans import registry

    turns = [(c, t) for c in range(3, 63) for t in range(c % 4 + 1)] + [(99, 0), (99, 1), (99, 3), (99, 12)]
    spark.createDataFrame(turns, "conv_id long, turn long").write.parquet(f"{tmp_path}/conversations.parquet")
    lines = [[f"{c}-{t}" for t in range(c % 4 + 1)] for c in range(3, 63)]
    want = [">".join(x) for x in lines] + ["99-0>99-1", "99-3", "99-12"]
    assert rows(registry.graph_paths(spark, str(tmp_path)), "path") == sorted((x,) for x in want)
    want = [">".join([*x, x[0]]) for x in lines if len(x) > 1] + ["99-0>99-1>99-0"]
    assert rows(registry.graph_cycles(spark, str(tmp_path)), "path") == sorted((x,) for x in want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=12))
def test_cycles_are_found_exactly_when_there_are_some(pairs):
    s: dict[str, list[str]] = {}
    for a, b in pairs:
        s.setdefault(str(a), []).append(str(b))
        s.setdefault(str(b), [])
    s = {k: sorted(set(v)) for k, v in sorted(s.items())}
    left = dict(s)
    while free := [n for n in left if not any(x in left for x in left[n])]:
        for n in free:
            del left[n]
    assert bool(graphs.cycles(s)) == bool(left)
    for ring in graphs.cycles(s):
        assert ring[0] == ring[-1] and all(b in s[a] for a, b in zip(ring, ring[1:]))


def test_subgraph_bound(spark):
    import pytest

    with pytest.raises(graphs.SubgraphTooLarge):
        graphs.collect_subgraph(edges(spark, [("a", "b"), ("b", "c")]), most=1)
