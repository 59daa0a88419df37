import csv
import json
from datetime import UTC, datetime

import pytest

from strataprobe.__main__ import main
from strataprobe.functions import records
from strataprobe.plans import captured, tools
from strataprobe.sources import bundles, ingest
from tests.bundle import NODE, A, B, C, D, E, X, Y, make


def shuffled(spark):
    """Bytes written to shuffles so far."""
    store, gate, jvm = spark._jsc.sc().statusStore(), spark.sparkContext._gateway, spark._jvm
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, gate.new_array(jvm.double, 0), jvm.java.util.ArrayList()).iterator()
    total = 0
    while stages.hasNext():
        total += stages.next().shuffleWriteBytes()
    return total


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("TS123456789") / "case"
    root.mkdir()
    return make(root)


def table(path):
    with open(path, encoding="utf-8", newline="") as f:
        return list(csv.DictReader(f))


def load(path):
    return json.loads(path.read_text())


@pytest.mark.parametrize(
    "text,mode,n",
    [("[1, {}]", "json", 1), ("", "empty", 0), (" \n", "empty", 0), ("not json", "unparseable", 0), ('{"a":1}\n\n{"b":2}\r\n', "json-lines", 2), ('{"a":1}\nbad\n', "json-lines", 1), ('{"a":1}garbage', "unparseable", 0)],
)
def test_documents(text, mode, n):
    docs, got = ingest.parse_documents(text)
    assert (got, len(docs)) == (mode, n)


def test_unwrapping():
    assert ingest.unwrapped({"Allocations": [{"a": 1}, 2], "Items": [{}]}, ["Allocations", "Items"], None) == [{"a": 1}]
    assert ingest.unwrapped({"x": 1}, ["Items"], None) == [{"x": 1}]
    assert ingest.unwrapped({"x": 1}, ["Items"], ["ID"]) == []
    assert ingest.unwrapped({"ID": ""}, ["Items"], ["ID"]) == []
    nested = {"Alloc": {"ID": "i", "inner": [{"id": "i"}]}}
    assert len(list(ingest.nested_with_id(nested, ["ID", "id"], "i"))) == 2


def test_unreadable_files_are_named(spark, tmp_path):
    files = spark.createDataFrame([(str(tmp_path / "gone.log"), "gone.log", 3)], bundles.LISTING)
    assert [tuple(r) for r in ingest.unreadable(files).collect()] == [("gone.log", "FileNotFoundError")]
    assert ingest.text_lines(files).count() == 0 and ingest.hashed(files).first()["sha256"] == "ERROR"
    assert [r["mode"] for r in ingest.json_records(files).collect()] == ["unparseable"]


def test_bundle_finding(tree, tmp_path):
    assert bundles.find_bundle(tree) == tree and bundles.find_bundle(tree.parent) == tree
    assert bundles.find_bundle(tmp_path) is None and bundles.find_bundle(tmp_path / "no") is None


def test_inventory(spark, tree, tmp_path):
    out = tools.inventory_bundle(spark, str(tree), str(tmp_path / "o"))
    rows = {r["relative_path"]: r for r in table(out / "inventory.csv")}
    assert "link.log" not in rows and rows["server/s1/_hidden.log"]["size_bytes"] == "0"
    log = rows["server/s1/monitor.log"]
    assert (log["line_count"], log["scan_status"], log["first_timestamp"], log["last_timestamp"]) == ("3", "full_scan", "2026-08-14T17:18:20.500000Z", "2026-08-14T18:00:00Z")
    s = load(out / "bundle_summary.json")
    assert s["missing_interval_ids"] == ["0002"] and s["index_json_entries"] == 2 and s["interval_artifact_presence"]["allocations.json"] == 3
    assert s["server_profile_ids"] == {"s1": ["0000", "0002"]}
    assert "missing: 0001" in (out / "inventory.md").read_text()


def test_find(spark, tree, tmp_path):
    out = tools.find_identifiers(spark, str(tree), [A, "zzz"], str(tmp_path / "o"))
    s = load(out / "summary.json")
    assert s["results"]["zzz"]["occurrences"] == 0 and s["read_errors"] == 0
    rows = table(out / "results.csv")
    assert rows[0]["category"] == "event_stream"
    client = next(r for r in rows if r["relative_path"] == "client/c1/monitor.log")
    assert (client["match_count"], client["matching_lines"], client["last_match_line"]) == ("3", "2", "2")


def test_window(spark, tree, tmp_path):
    start, end = datetime(2026, 8, 14, 17, 18, tzinfo=UTC), datetime(2026, 8, 14, 17, 18, 50, tzinfo=UTC)
    out = tools.extract_window(spark, str(tree), str(tmp_path / "o"), start, end, include_static=True, include_profiles=True)
    s = load(out / "summary.json")
    assert s["selected_intervals"] == ["0000", "0001"]
    rows = {(r["action"], r["relative_path"]): r for r in table(out / "manifest.csv")}
    assert rows["filtered_lines", "server/s1/monitor.log"]["matched_lines"] == "2"
    assert rows["copied_profile", "server/s1/heap_0000.prof"]["source_sha256"] == rows["copied_profile", "server/s1/heap_0000.prof"]["output_sha256"]
    assert ("copied_static", "cluster/eventstream.json") in rows
    assert (out / "extracted/server/s1/monitor.log").read_text().count("\n") == 2
    with pytest.raises(FileExistsError):
        tools.extract_window(spark, str(tree), str(tmp_path / "o"), start, end)


def test_window_reads_texts_to_their_end(spark, tmp_path):
    root = make(tmp_path)
    for i, name, text in (("0007", "jobs.json", "[" + '{"ID":"x"},' * 900_000), ("0008", "notes.txt", "nothing here\n" * 750_000)):
        (root / "interval" / i).mkdir()
        (root / "interval" / i / name).write_text(text + '{"At":"2026-08-14T17:18:31Z"},\n{"At":"2026-08-14T17:18:30Z"}]')
    at = datetime(2026, 8, 14, 17, 18, 30, tzinfo=UTC)
    s = load(tools.extract_window(spark, str(root), str(tmp_path / "o"), at, at) / "summary.json")
    assert (s["selected_intervals"], s["unparsed_intervals"]) == (["0007", "0008"], [])


def test_history(spark, tree, tmp_path):
    out = tools.alloc_history(spark, str(tree), A, str(tmp_path / "o"))
    rows = table(out / "timeline.csv")
    kinds = [r["event"] for r in rows if r["source_type"] == "allocation_snapshot"]
    assert kinds == ["allocation observed in interval snapshot", "snapshot change at interval 0003"]
    assert "client_status: 'running' -> 'failed'" in next(r["details"] for r in rows if "change at" in r["event"])
    assert rows[-1]["timestamp_utc"] == ""  # without a time: last
    s = load(out / "summary.json")
    assert (s["snapshot_count"], s["node_name"], s["matching_lines"]) == (3, "n1", 4)
    assert next(r["details"] for r in rows if r["source_type"] == "event_stream").startswith("index=5; client=running")


def test_correlate(spark, tree, tmp_path):
    out = tools.correlate_timeline(spark, str(tree), str(tmp_path / "o"), allocs=[A])
    rows = table(out / "timeline.csv")
    both = next(r for r in rows if r["source_type"] == "correlated_monitor_log")
    assert both["source_group"] == "client,server" and both["source_line"] == "" and both["event"] == "task restarting"
    s = load(out / "summary.json")
    assert s["suppressed_debug_lines"] == 1 and s["monitor_matches"] == 3
    assert s["parse_modes"]["allocations.json:json-lines"] == 1
    whole = tools.correlate_timeline(spark, str(tree), str(tmp_path / "o"), nodes=[NODE], start=datetime(2026, 8, 14, 17, 18, tzinfo=UTC), end=datetime(2026, 8, 14, 17, 18, 30, tzinfo=UTC))
    seen = table(whole / "timeline.csv")
    assert {r["source_type"] for r in seen} == {"interval_snapshot"} and all(r["timestamp_utc"].startswith("2026-08-14T17:18:10") for r in seen)


def test_lineage(spark, tree, tmp_path):
    out = tools.alloc_lineage(spark, str(tree), A, str(tmp_path / "o"))
    rows = {r["allocation_id"]: r for r in table(out / "lineage.csv")}
    assert {k: r["depth_from_seed"] for k, r in rows.items()} == {A: "0", B: "1", C: "2", D: "2", E: "3"}
    assert rows[B]["successors"] == f"{C},{D}" and rows[A]["client_status"] == "failed" and rows[A]["node_name"] == "n1"
    g, s = load(out / "graph.json"), load(out / "summary.json")
    assert g["branch_points"] == [B] and g["paths"] == [[A, B, C], [A, B, D, E]] and s["missing"] == [E]
    assert any(a["id"] == B and a["client_description"] == "first" for a in load(out / "allocations.json"))


def test_trace(spark, tree, tmp_path):
    out = tools.eval_trace(spark, str(tree), str(tmp_path / "o"), alloc=A)
    rows = {r["evaluation_id"]: r for r in table(out / "eval_trace.csv")}
    assert set(rows) == {X, Y} and rows[X]["related_allocations"] == ",".join(sorted([A, B, C, D]))
    s = load(out / "summary.json")
    assert s["cycles"] == 1 and s["roots"] == 0 and s["paths"] == 2
    with pytest.raises(tools.SeedError):
        tools.eval_trace(spark, str(tree), str(tmp_path / "o"), alloc=E)


def test_review(spark, tree, tmp_path):
    context = tmp_path / "c.json"
    context.write_text(json.dumps({"schema_version": 1, "classification": "lead", "case_reference": "TS1", "seeds": {"allocation_ids": [A, E], "job_ids": ["web"]}, "claims_to_test": [{"id": "c", "claim": "it broke"}]}))
    out = tools.case_review(spark, str(tree), str(context), str(tmp_path / "o"))
    rows = table(out / "report.csv")
    assert [r["observation_state"] for r in rows if r["seed_value"] == E] == ["not observed in captured state"]
    s = load(out / "summary.json")
    assert (s["observed_seed_count"], s["not_observed_seed_count"], s["claim_confirmation_count"]) == (2, 1, 0)
    assert s["parsing"]["parse_modes"]["jobs.json:empty"] == 1 and s["parsing"]["parse_modes"]["deployments.json:unparseable"] == 1
    context.write_text("{}")
    with pytest.raises(tools.InputError):
        tools.case_review(spark, str(tree), str(context), str(tmp_path / "o2"))


@pytest.mark.parametrize("needles,whole", [(16, 1 << 25), (0, 1 << 25), (16, 200), (0, 200)])
def test_review_keeps_no_records(spark, tmp_path, monkeypatch, needles, whole):
    """However files are read, records that carry no seed are neither cached nor shuffled, and the report is the same."""
    tree = make(tmp_path / "b")
    with open(tree / "cluster/eventstream.json", "a") as f:
        f.writelines(json.dumps({"Index": n, "Topic": "Allocation", "Payload": {"Allocation": {"ID": f"other-{n}", "JobID": f"j{n}", "NodeID": "n" * 50}, "Node": None}}) + "\n" for n in range(8000))
    with open(tree / "interval/0001/allocations.json", "a") as f:
        f.writelines(json.dumps({"ID": f"other-{n}", "JobID": f"j{n}", "EvalID": f"e{n}", "NodeID": "n" * 50}) + "\n" for n in range(8000))
    size = sum(p.stat().st_size for p in tree.rglob("*") if p.is_file())
    context = tmp_path / "c.json"
    context.write_text(json.dumps({"schema_version": 1, "classification": "lead", "case_reference": "TS1", "seeds": {"allocation_ids": [A, E], "job_ids": ["web"], "node_ids": [NODE]}}))
    monkeypatch.setattr(tools, "NEEDLES", needles)
    monkeypatch.setattr(tools.ingest.splits, "WHOLE_BYTES", whole)
    counts, cached = tools.review.seed_counts, []

    def seen(rows):
        out = counts(rows)
        out.count()
        cached.append(sum(r.memSize() + r.diskSize() for r in spark._jsc.sc().getRDDStorageInfo()))
        return out

    monkeypatch.setattr(tools.review, "seed_counts", seen)
    spark.catalog.clearCache()
    before = shuffled(spark)
    out = tools.case_review(spark, str(tree), str(context), str(tmp_path / "o"))
    assert size > 1_500_000 and cached[0] < size / 8 and shuffled(spark) - before < size / 8
    rows = table(out / "report.csv")
    order = [tuple(r[c] for c in [*tools.OBSERVATION[:3], "source_artifact", "interval", "source_line", *tools.OBSERVATION[-2:]]) for r in rows]
    assert order == sorted(order)
    found = {}
    for r in rows:
        key = (r["seed_value"], r["evidence_type"])
        found[key] = found.get(key, 0) + 1
    assert found == {(A, "interval_snapshot"): 3, (A, "eventstream_payload"): 1, (E, ""): 1, ("web", "interval_snapshot"): 18, ("web", "eventstream_payload"): 1, (NODE, "interval_snapshot"): 15, (NODE, "eventstream_payload"): 2}
    parsing = load(out / "summary.json")["parsing"]
    assert (parsing["eventstream_records"], parsing["records_read"]["allocations.json"], parsing["parse_modes"]["allocations.json:json-lines"]) == (8002, 8012, 1)


def test_intake(spark, tree, tmp_path):
    (tree.parent / "notes.txt").write_text("x")
    (tree.parent / "graph.png").write_text("x")
    out = tools.case_intake(spark, str(tree.parent), str(tmp_path / "o"))
    s = load(out / "summary.json")
    assert s["artifact_category_counts"] == {"image_or_graph": 1, "log_or_text": 1} and s["selected_bundle"]["interval_count"] == 3
    with pytest.raises(tools.InputError):
        tools.case_intake(spark, str(tmp_path), str(tmp_path / "o3"))


def test_exit_codes(spark, tree, tmp_path):
    assert main(["lineage", str(tree), "--alloc", "nope", "--output", str(tmp_path / "a")]) == 2
    assert main(["trace", str(tree), "--alloc", E, "--output", str(tmp_path / "b")]) == 3
    assert main(["find", str(tree), "--id", "web", "--output", str(tmp_path / "c")]) == 0
    assert main(["window", str(tree), "--start", "2026-08-14T17:00:00", "--end", "2026-08-14T18:00:00Z"]) == 2


def test_inventory_without_limits_scans_whole_files(spark, tmp_path):
    root = make(tmp_path)
    with open(root / "server/s1/long.log", "w") as f:
        f.writelines("2024-01-10T00:00:00Z line\n" for _ in range(250_000))
        f.write("2024-01-11T00:00:00Z last\n")
    for n, limits in enumerate(({}, {"max_scan_mb": None, "max_lines": None})):
        out = tools.inventory_bundle(spark, str(root), str(tmp_path / f"o{n}"), **limits)
        with open(out / "inventory.csv", newline="") as f:
            row = next(r for r in csv.DictReader(f) if r["relative_path"] == "server/s1/long.log")
        whole = (row["scan_status"], row["line_count"], row["last_timestamp"])
        assert whole == (("full_scan", "250001", "2024-01-11T00:00:00Z") if limits else ("partial_scan:line_limit=250000", "", "2024-01-10T00:00:00Z"))


def test_the_bundle_is_made_without_shuffling_its_lines(spark):
    def shuffled():
        store, gate, jvm = spark._jsc.sc().statusStore(), spark.sparkContext._gateway, spark._jvm
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, gate.new_array(jvm.double, 0), jvm.java.util.ArrayList()).iterator()
        total = 0
        while stages.hasNext():
            s = stages.next()
            total += s.shuffleWriteBytes() + s.outputBytes()
        return total

    captured._made.clear()
    before = shuffled()
    root = captured.case(spark, "/root/testdata/sf0.01")
    size = sum(p.stat().st_size for p in root.rglob("*") if p.is_file())
    assert size > 4_000_000 and shuffled() - before < size / 8
    assert sorted(p.name for p in root.iterdir()) == ["nomad-debug-sf", "notes.txt", "rows.csv"]


def merged(spark, monkeypatch, latest_wins):
    alloc = '{"ID":"a","NodeID":"n1","ClientStatus":""}'
    snaps = [("interval/0001/allocations.json", "json", 0, alloc, "0001", "allocations.json"), ("interval/0003/allocations.json", "json", 0, alloc, "0003", "allocations.json")]
    payload = '{"Payload":{"Allocation":{"ID":"%s","NodeID":"n2","ClientStatus":"%s"}}}'
    stream = [("s.json", 7, payload % ("a", "late")), ("s.json", 3, payload % ("a", "early")), ("s.json", 4, payload % ("b", "only")), ("s.json", 5, '{"Payload":null}')]
    monkeypatch.setattr(tools.ingest, "snapshots", lambda *a, **k: spark.createDataFrame(snaps, "rel string, mode string, elem_idx int, record_json string, interval_id string, artifact string"))
    monkeypatch.setattr(tools, "stream_rows", lambda *a: spark.createDataFrame(stream, "rel string, line_no long, record_json string").mapInPandas(lambda frames: frames, "rel string, line_no long, record_json string"))
    out, snaps = tools.merged_entities(None, "allocations.json", "Allocation", records.allocation_summary, records.ALLOCATION_IDS, latest_wins)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    rows = {r["id"]: (r["node_id"], r["client_status"], r["first_seen_interval"], r["last_seen_interval"], r["sources"]) for r in out.collect()}
    snaps.unpersist()
    return plan.count("MapInPandas"), rows


def test_lineage_reads_the_stream_once(spark, monkeypatch):
    times, rows = merged(spark, monkeypatch, latest_wins=False)
    sources = ["interval/0001/allocations.json", "interval/0003/allocations.json", "s.json:3", "s.json:7"]
    assert rows == {"a": ("n1", "early", "0001", "0003", sources), "b": ("n2", "only", "", "", ["s.json:4"])}
    assert times == 1


def test_trace_merges_in_one_aggregation(spark, monkeypatch):
    times, rows = merged(spark, monkeypatch, latest_wins=True)
    assert rows["a"][:4] == ("n2", "late", "0001", "0003") and rows["b"] == ("n2", "only", "", "", ["s.json:4"])
    assert times == 1


def counted(spark, df):
    """(df, the number of its rows that were computed so far)."""
    n = spark.sparkContext.accumulator(0)

    def through(frames):
        for f in frames:
            n.add(len(f))
            yield f

    return df.mapInPandas(through, df.schema), n


def test_a_connected_part_reads_its_edges_once(spark):
    edges, n = counted(spark, spark.createDataFrame([(f"n{i}", f"n{i + 1}", "next") for i in range(4)], "src string, dst string, relation string"))
    near, part, missing = tools.connected_part(edges, spark.createDataFrame([("n0",), ("n1",)], "id string"), "n1", 2)
    assert (near.count(), part.count(), sorted(r["node"] for r in missing.collect())) == (4, 3, ["n2", "n3"])
    assert n.value == 4


@pytest.mark.parametrize("needles", [16, 0])
def test_trace_merges_linked_allocations_alone(spark, tmp_path, monkeypatch, needles):
    monkeypatch.setattr(tools, "NEEDLES", needles, raising=False)
    tree = make(tmp_path / "b")
    far = "77777777-0000-4000-8000-000000000000"
    path = tree / "interval/0003/allocations.json"
    more = [{"ID": far, "EvalID": far}, {"ID": C, "EvalID": far}, {"ID": E, "EvalID": Y, "JobID": "late"}]
    path.write_text(json.dumps(json.loads(path.read_text()) + more))
    merge, ids = tools.changes.merge_by_id, set()

    def seen(rows, *a, **k):
        ids.update(r["id"] for r in rows.select("id").distinct().collect())
        return merge(rows, *a, **k)

    monkeypatch.setattr(tools.changes, "merge_by_id", seen)
    out = tools.eval_trace(spark, str(tree), str(tmp_path / "o"), alloc=A)
    rows = {r["evaluation_id"]: r["related_allocations"] for r in table(out / "eval_trace.csv")}
    assert rows == {X: ",".join(sorted([A, B, D])), Y: E}  # C's latest evaluation is another
    assert far not in ids and {A, B, C, D, E} <= ids
    kept = {a["id"]: a for a in load(out / "allocations.json")}
    assert kept[E]["job_id"] == "late" and kept[A]["node_name"] == "n1" and kept[A]["first_seen_interval"] == "0000" and len(kept[A]["sources"]) == 4


def test_correlate_reads_the_stream_once(spark, tree, tmp_path, monkeypatch):
    rows = tools.stream_rows(tools.bundles.listing(spark, str(tree)))
    stream, n = counted(spark, rows)
    monkeypatch.setattr(tools, "stream_rows", lambda *a: stream)
    tools.correlate_timeline(spark, str(tree), str(tmp_path / "o"), allocs=[A])
    assert n.value == 2
