import csv
import json

import pytest
from pyspark.sql import functions as F

from strataprobe.operators import ordinals, search
from strataprobe.sources import placed, sinks


def read(path):
    with open(path, encoding="utf-8", newline="") as f:
        return list(csv.reader(f))


def test_csv_by_many_tasks(spark, tmp_path):
    df = spark.range(5000).repartition(7).selectExpr("id", "concat('a,\"', id, '\\n') AS quoted", "if(id % 3 = 0, null, 'é漢') AS some", "id % 2 = 0 AS flag", "'' AS empty").orderBy("id")
    assert sinks.csv_file(df, tmp_path / "o.csv") == 5000
    rows = read(tmp_path / "o.csv")
    assert rows[0] == df.columns and rows[1:] == [[str(i), f'a,"{i}\n', "" if i % 3 == 0 else "é漢", str(i % 2 == 0), ""] for i in range(5000)]
    assert [p.name for p in tmp_path.iterdir()] == ["o.csv"]
    assert sinks.csv_file(df.limit(0), tmp_path / "none.csv") == 0 and read(tmp_path / "none.csv") == [df.columns]
    assert sinks.csv_file(df.select("empty").limit(2), tmp_path / "one.csv") == 2 and read(tmp_path / "one.csv") == [["empty"], [""], [""]]


def test_many_files_with_head_and_tail(spark, tmp_path):
    rows = spark.range(3000).repartition(5).select(F.concat(F.lit("d/"), (F.col("id") % 4).cast("string")).alias("file"), F.concat(F.col("id").cast("string"), F.lit("\n")).alias("data"), "id")
    counts = placed.write_placed(rows, tmp_path, ["file", "id"], head="<\n", tail=">")
    assert counts == {f"d/{k}": 750 for k in range(4)}
    for k in range(4):
        assert (tmp_path / f"d/{k}").read_text() == "<\n" + "".join(f"{i}\n" for i in range(k, 3000, 4)) + ">"


def test_a_failed_write_leaves_nothing(spark, tmp_path, monkeypatch):
    class Broken(placed.PlacedWriter):
        def write(self, iterator):
            out = super().write(iterator)
            if TaskContext.get().partitionId() == 1:
                raise RuntimeError("lost")
            return out

    from pyspark import TaskContext

    (tmp_path / "f").write_text("before")
    rows = spark.range(100).select(F.lit("f").alias("file"), F.lit("x").alias("data"), "id")
    monkeypatch.setattr(placed, "PlacedWriter", Broken)
    with pytest.raises(Exception, match="lost"):
        placed.write_placed(rows, tmp_path, ["file", "id"])
    assert (tmp_path / "f").read_text() == "before" and [p.name for p in tmp_path.iterdir()] == ["f"]


def test_ordinals_and_running_sums(spark, monkeypatch):
    monkeypatch.setattr(ordinals, "BLOCK", 70)
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(6)
    rows = ordinals.running_sum(ordinals.with_ordinal(df, [F.col("v").desc()]), F.col("v") % 3, "ordinal", "total").collect()
    want, total = {}, 0
    for i in range(1000):
        total += (999 - i) % 3
        want[i] = (999 - i, total)
    assert {r["ordinal"]: (r["v"], r["total"]) for r in rows} == want
    assert ordinals.with_ordinal(df.limit(0), ["v"]).collect() == []


@pytest.mark.parametrize("ignore_case", [False, True])
def test_the_automaton_agrees_with_expressions(spark, ignore_case):
    lines = [("p", i, x) for i, x in enumerate(["aaaa aba ABA", "", "abababa", "Straße STRASSE", "xyz", "a\nb ab", "éÉ é"])]
    df = spark.createDataFrame([*lines, ("q", 9, None)], "path string, line_no int, line string")
    ids = ["a", "aa", "aba", "ab", "ABA", "b a", "é", "ß", "xyz", "yz", "none", "a\nb"] + [f"zz{i}" for i in range(30)]
    key = lambda rows: sorted(map(tuple, rows.select("identifier", "path", "line_no", "line", "occurrences").collect()))
    want = key(search.line_matches(df, ids, ignore_case))
    assert key(search.line_matches(df, ids, ignore_case, few=0)) == want and len(want) > 15


def test_ten_thousand_identifiers_in_one_pass(spark):
    lines = spark.range(2000).selectExpr("'p' AS path", "cast(id as int) AS line_no", "concat('k', id * 5, '. and k', id * 5, ', k', id, '.') AS line")
    got = search.match_counts(search.line_matches(lines, [f"k{i}." for i in range(10_000)]))
    rows = {r["identifier"]: r["match_count"] for r in got.collect()}
    assert rows == {f"k{i}.": (i < 2000) + (i % 5 == 0) for i in range(10_000) if i < 2000 or i % 5 == 0}


def test_markdown_holds_every_row(spark, tmp_path, monkeypatch):
    df = spark.range(500).repartition(6).selectExpr("id", "concat('a|', id, '\n') AS text").orderBy("id")
    sections = [("Few", "some text"), ("Table", df), ("Middle", "more"), ("Small", df.limit(2)), ("Again", df.orderBy(F.col("id").desc()))]
    sinks.markdown_file(tmp_path / "driver.md", "T", *sections)
    monkeypatch.setattr(sinks, "SHORT", 10)
    sinks.markdown_file(tmp_path / "tasks.md", "T", *sections)
    text = (tmp_path / "tasks.md").read_text()
    assert text == (tmp_path / "driver.md").read_text() and text.count("a\\|") == 1002
    assert sinks.first_of(["x", "y", "z"], 2, "things") == "- x\n- y\n- … 1 more things"


def test_fixed_ranges_are_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordinals, "RANGE_ROWS", 300)
    rows = ordinals.fixed_ranges(spark.range(2000).repartition(3).selectExpr("(id * 7919) % 2000 AS k"), "k")
    assert rows.rdd.getNumPartitions() > 4
    each = rows.selectExpr("inline(array(struct('a' AS file, 'é' || k || ';' AS data), struct(if(k % 2 = 0, 'd/even', 'd/odd') AS file, k || ',' AS data)))")
    counts = placed.write_placed(each, tmp_path, None, head={"a": "é<", "d/odd": "["}, tail={"a": ">"}, fixed=True)
    assert counts == {"a": 2000, "d/even": 1000, "d/odd": 1000}
    assert (tmp_path / "a").read_text() == "é<" + "".join(f"é{i};" for i in range(2000)) + ">"
    assert (tmp_path / "d/even").read_text() == "".join(f"{i}," for i in range(0, 2000, 2))
    assert (tmp_path / "d/odd").read_text() == "[" + "".join(f"{i}," for i in range(1, 2000, 2))


def test_json_holds_every_row_of_long_tables(spark, tmp_path):
    df = spark.range(100_001).repartition(5).selectExpr("id", "if(id % 2 = 0, null, concat('é\"', id)) AS text", "array(id) AS l").orderBy("id")
    want = [{"id": i, "text": None if i % 2 == 0 else f'é"{i}', "l": [i]} for i in range(100_001)]
    few = df.where("id < 3")
    sinks.json_file({"a": 1, "rows": df, "b": few, "again": df, "end": ["x"]}, tmp_path / "o.json")
    assert json.loads((tmp_path / "o.json").read_text()) == {"a": 1, "rows": want, "b": want[:3], "again": want, "end": ["x"]}
    sinks.json_file(df, tmp_path / "list.json")
    assert json.loads((tmp_path / "list.json").read_text()) == want
    sinks.json_file(few, tmp_path / "few.json")
    assert (tmp_path / "few.json").read_text() == json.dumps(want[:3], indent=2) + "\n"


@pytest.mark.parametrize("bits", [26, 4])
def test_identifiers_of_a_table(spark, monkeypatch, bits):
    monkeypatch.setattr(search, "SKETCH_BITS", bits)
    monkeypatch.setattr(search, "HASHED", 16)
    lines = [("p", i, x) for i, x in enumerate(["aaaa aba ABA", "", "abababa", "Straße STRASSE", "xyz", "a\nb ab", "éÉ é", "a", "b"])]
    df = spark.createDataFrame([*lines, ("q", 9, None)], "path string, line_no int, line string")
    ids = ["a", "aa", "aba", "ab", "ABA", "b a", "é", "ß", "xyz", "yz", "none", "a\nb", "xyza", "ab" * 40, "a"]
    table = spark.createDataFrame([(x,) for x in [*ids, None]], "identifier string")
    key = lambda rows: sorted(map(tuple, rows.select("identifier", "path", "line_no", "line", "occurrences").collect()))
    want = key(search.line_matches(df, ids))
    assert key(search.matches_of(df, table)) == want and len(want) > 15
