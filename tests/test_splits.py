"""Files over many byte ranges against plain Python, with ranges of a few bytes."""

import hashlib
import json
import random

import pytest

from strataprobe.operators import inventory
from strataprobe.sources import bundles, ingest, splits

TEXTS = {
    "a b%20c+é[1]{x}*.log": "one\r\ntwo\rthree\n\nfive".encode(),
    "crlf.log": b"".join(b"line %d\r\n" % i for i in range(50)),
    "empty.log": b"",
    "_hidden.log": b"hid\nden\n",
    "bad.log": b"ok\xff\xfe\xe9x\nq\n",
    "ends.txt": b"\n\n\r\n\r",
    "wide.txt": "漢字é\n".encode() * 30,
}


@pytest.fixture
def tiny(spark):
    """Byte ranges of a few bytes."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def put(spark, folder, texts):
    for name, raw in texts.items():
        (folder / name).write_bytes(raw if isinstance(raw, bytes) else raw.encode())
    return spark.createDataFrame([(str(folder / n), n, (folder / n).stat().st_size) for n in texts], bundles.LISTING)


@pytest.mark.parametrize("whole", [None, 0])
@pytest.mark.parametrize("size", [5, 12])
def test_line_numbers(spark, tmp_path, tiny, whole, size):
    files = put(spark, tmp_path, TEXTS)
    tiny(size if whole == 0 else 1 << 20)
    got = {}
    for r in splits.lines(files, whole).collect():
        got.setdefault(r["path"], []).append((r["line_no"], r["line"]))
    for name in TEXTS:
        with open(tmp_path / name, encoding="utf-8", errors="replace") as f:
            want = [(i, line.removesuffix("\n")) for i, line in enumerate(f, 1)]
        assert sorted(got.get(name, [])) == want, name


def test_one_log_is_read_by_many_tasks(spark, tmp_path, tiny):
    files = put(spark, tmp_path, {"big.log": "".join(f"{i} some words\n" for i in range(4000))})
    tiny(2000)
    lines = splits.lines(files, 0)
    assert lines.rdd.getNumPartitions() > 20 and lines.where("line like concat(line_no - 1, ' %')").count() == 4000
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "InPandas" not in plan and "ArrowEval" not in plan


def value(rng, depth=0):
    k = rng.randrange(7 if depth < 3 else 4)
    if k < 4:
        return [rng.randrange(99), 'a,b"]{\\ é\n'[: rng.randrange(11)], None, True][k]
    if k < 6:
        return {rng.choice(["ID", "x,y", 'z"{']): value(rng, depth + 1) for _ in range(rng.randrange(3))}
    return [value(rng, depth + 1) for _ in range(rng.randrange(4))]


def documents():
    rng = random.Random(3)
    docs = {f"l{i}.json": json.dumps([value(rng) for _ in range(rng.randrange(6))], indent=rng.choice([None, 2])) + rng.choice(["", "\n", " "]) for i in range(8)}
    for i in range(8):
        v = {"Meta": value(rng), "Allocations": [value(rng) for _ in range(rng.randrange(6))] if i % 3 else 5, "q": value(rng), "Items": [value(rng, 1) for _ in range(3)], "ID": "" if i % 2 else "x"}
        docs[f"w{i}.json"] = json.dumps(v, indent=rng.choice([None, 1]))
    odd = ["[1],", "[1][2]", "[1,,2]", '{"a":[1,2],}', "[1,2", '[1,"x]', '[{"a" 1}]', '{"a":[1,]}', "[1}]", "[]", " { } ", '{"Items":[ ]}', '{"a":1}\n{"b":[1,{"ID":2}]}\n\n{"Items":[{"c":1},{"d":2},3]}\nbroken\n', "]", '{"a":[1] 5}', '{"Items":1,"Items":[2,{"e":3}],"Items":[{"f":4}]}', "[1] x", " \n ", "", "words\nalone", '{"t":{"u":[1,{"ID":"x"}]},"e":[]}', '[{"ID":"x","in":[{"ID":"x"}]},[{"ID":"x"}]]']
    return docs | {f"o{i}.json": text for i, text in enumerate(odd)}


@pytest.mark.parametrize("size, how", [(7, {"ids": ["ID"]}), (40, {"wrappers": ["Allocations", "Items"]})])
def test_records_of_split_files(spark, tmp_path, tiny, size, how):
    files = put(spark, tmp_path, documents())
    want = sorted(map(repr, map(tuple, ingest.json_records(files, **how).select("rel", "mode", "elem_idx", "record_json").collect())))
    tiny(size)
    got = sorted(map(repr, map(tuple, ingest.json_records(files, **how, whole_bytes=0).select("rel", "mode", "elem_idx", "record_json").collect())))
    assert got == want
    assert {x.split(", ")[1] for x in want} == {"'json'", "'json-lines'", "'empty'", "'unparseable'"}
    assert {x.split(", ")[0].strip("('") for x in want} == set(documents())


def test_events_and_deep_ids_of_split_files(spark, tmp_path, tiny):
    files = put(spark, tmp_path, documents())
    deep = {"deep_id": (["ID"], "x")}
    lists = {n for n, t in documents().items() if not t.lstrip().startswith("{") or "\n{" in t or '"t"' in t}
    events = sorted(map(tuple, ingest.event_records(files).collect()))
    found = sorted(map(repr, map(tuple, ingest.json_records(files.where(files.rel.isin(lists)), **deep).collect())))
    tiny(30)
    assert sorted(map(tuple, ingest.event_records(files, whole_bytes=0).collect())) == events and len(events) > 10
    assert sorted(map(repr, map(tuple, ingest.json_records(files.where(files.rel.isin(lists)), **deep, whole_bytes=0).collect()))) == found


def test_heads_tell_files_of_lines(spark, tmp_path):
    line = '{"a":"' + "x" * 90 + '"}\n'
    put(spark, tmp_path, {"lines.json": line * 40, "list.json": "[" + line * 40, "wide.json": '{\n"a":[1,\n' + line * 40, "small.json": line, "one.json": line + " \n" * 900})
    rows = [(str(tmp_path / n), n, (tmp_path / n).stat().st_size) for n in ("lines.json", "list.json", "wide.json", "small.json", "one.json")]
    assert {r[1] for r in splits.lined(spark, rows, probe=1000)} == {"lines.json"}


def test_shapes_compose():
    assert splits.reduced("][{}[") == "][[" and splits.reduced("[{]}") == "[{]}"
    text = '{"a,[":[1,{"b":"}\\"]"},[2]],"c":3}'
    for cut in range(len(text)):
        left, inside, outside = splits.Shape(False), splits.Shape(True), splits.Shape(False)
        left.feed(text[:cut])
        if text[:cut].endswith("\\"):
            continue  # ranges begin at commas, and no escape does
        inside.feed(text[cut:]), outside.feed(text[cut:])
        assert splits.reduced(left.brackets + (inside if left.quoted else outside).brackets) == ""


def test_heads_hashes_and_caps(spark, tmp_path, tiny):
    files = put(spark, tmp_path, TEXTS | {"doc.json": json.dumps([{"n": i, "é": "x"} for i in range(200)])})
    raw = {n: (tmp_path / n).read_bytes() for n in [*TEXTS, "doc.json"]}
    for whole, size in ((None, 1 << 20), (0, 40)):
        tiny(size)
        for n in (10, 90):
            chars = {r["rel"]: r["text"] for r in splits.heads(files, chars=n, whole_bytes=whole).collect()}
            some = {r["rel"]: r["text"] for r in splits.heads(files, size=n, whole_bytes=whole).collect()}
            for name in ("doc.json", "wide.txt"):
                assert chars[name] == raw[name].decode()[:n]
                assert some[name] == raw[name][:n].decode("utf-8", "replace")
    assert {r["rel"]: r["sha256"] for r in splits.hashes(files).collect()} == {n: hashlib.sha256(b).hexdigest() for n, b in raw.items()}
    # the byte cap counts bytes over ranges, and the line that reaches it is in
    tiny(30)
    kept = inventory.bounded_lines(splits.lines(files.where("rel = 'wide.txt'"), 0), max_bytes=25)
    assert sorted(r["line_no"] for r in kept.collect()) == [1, 2, 3]
    assert inventory.bounded_lines(splits.lines(files.where("rel = 'wide.txt'"), 0), max_lines=7).count() == 7


def test_lines_that_may_hold(spark):
    """Lines are left out before they are parsed only if no record of theirs can hold a needle."""
    from pyspark.sql import functions as F

    def kept(line, *needles):
        return spark.createDataFrame([(line,)], "line string").where(ingest.may_hold(F.col("line"), list(needles))).count() == 1

    uuid = "00000000-0000-4000-8000-000000000002"
    assert kept('{"ID": "%s"}' % uuid, uuid) and not kept('{"ID": "x"}', uuid) and kept('{"ID": "x"}')
    assert kept('{"ID": "\\u0030"}', uuid) and kept('{"Payload": {"Evaluation": 1}}', '"Evaluation"') and not kept('{"Payload": 1}', '"Evaluation"')
    for needle in ("100000", "1e-05", "0.5", "-1", "5e-5", '"a":1', "a b", "é"):  # how a number or a separator is written may change
        assert kept('{"n": 1E5}', needle), needle


def test_event_lines_by_needle(spark, tmp_path, monkeypatch):
    """The parser sees the lines alone that may hold a needle, and the rows are those a filter afterwards keeps."""
    file = tmp_path / "eventstream.json"
    file.write_text("".join('{"n": %d, "id": "al-%d"}\n' % (i, i % 50) for i in range(500)))
    files = spark.createDataFrame([(str(file), "eventstream.json", file.stat().st_size)], "path string, rel string, length long")
    some = ingest.event_records(files, whole_bytes=0, needles=["al-7"])
    assert [r["line_no"] for r in some.orderBy("line_no").collect()] == list(range(8, 501, 50))
    assert ingest.event_records(files, whole_bytes=0).count() == 500


def test_texts_of_records_are_cut_once(spark, tmp_path, tiny, monkeypatch):
    rows = [{"ID": f"c-{i}", "Tags": ["a]\\\",", {"n": i}]} if i % 7 else i for i in range(200)]
    files = put(spark, tmp_path, {"list.json": json.dumps(rows, indent=1), "evaluations.json": json.dumps({"Meta": {"of": [1]}, "Evaluations": rows, "Items": [{}]})})
    tiny(1000)
    cut, written = splits.cut, []

    def seen(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(splits, "cut", seen)
    monkeypatch.setattr(ingest.graphs, "cut", seen)
    found = ingest.json_records(files, whole_bytes=0).where("mode = 'json'").collect()
    for rel in ("list.json", "evaluations.json"):
        mine = sorted((r for r in found if r["rel"] == rel), key=lambda r: r["elem_idx"])
        assert [json.loads(r["record_json"]) for r in mine] == [r for r in rows if isinstance(r, dict)]
    assert sum(written) < 2.5 * 2 * len(rows)
