from strataprobe.streaming import logs


def test_stream_classifies_and_dedupes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    line = "2026-08-14T10:18:20.500-0700 [INFO] task restarting"
    (src / "a.log").write_text(line + "\nno time\n2026-08-14T10:18:21.000-0700 GET /v1/agent/host\n")
    (src / "b.log").write_text(line + "\n")
    events = logs.deduplicated(logs.classified(logs.log_stream(spark, str(src))))
    q = events.writeStream.format("memory").queryName("log_events").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("log_events").collect()
    assert [(r["event"], r["message"]) for r in rows] == [("task restarting", "[INFO] task restarting")]


def test_windowed_counts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.log").write_text("2026-08-14T10:18:20Z restarting\n2026-08-14T10:19:20Z restarting\n2026-08-14T10:29:20Z drain\n")
    counts = logs.event_counts(logs.classified(logs.log_stream(spark, str(src))))
    q = counts.writeStream.format("memory").queryName("log_counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["event"], r["n"]) for r in spark.table("log_counts").collect()) == [("node drain", 1), ("task restarting", 2)]
