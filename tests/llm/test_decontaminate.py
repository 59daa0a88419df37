import random
import re

import pytest

from strataprobe.llm import decontaminate as dc

from .helpers import LOW, corpus, frame, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(rows, items, window=10):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOW))
        size = min(len(w), window)
        for s in range(len(w) - size + 1) if w else ():
            windows.setdefault(tuple(w[s : s + size]), set()).add("" if i is None else str(i))
    out = []
    for d, t, _, _ in rows:
        w = WORD.findall((t or "").translate(LOW))
        hit, names = set(), set()
        for size in {len(k) for k in windows}:
            for s in range(len(w) - size + 1):
                if (k := tuple(w[s : s + size])) in windows:
                    hit |= set(range(s, s + size))
                    names |= windows[k]
        out.append((d is None, d or 0, len(w), len(hit), len(names), ",".join(sorted(names)), bool(hit)))
    return sorted(out)


def found(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"]) for r in df.collect())


def case(seed):
    rng = random.Random(seed)
    rows = corpus(seed, 40)
    items = [(i, prose(rng, rng.choice([1, 2, 3, 5, 9, 10, 11, 30]), 300)) for i in range(25)] + [(100, None), (101, "--"), (None, "Null id Words here")]
    for i in range(30):
        text = items[rng.randrange(25)][1]
        cut = text if i % 3 else " ".join(text.split(" ")[3:20])
        rows.append((3000 + i, prose(rng, 30, 300) + ", " + cut.upper() + " . " + (cut if i % 4 == 0 else "") + " " + prose(rng, 5, 300), "en", "s"))
    return rows, items


@pytest.mark.parametrize("seed,small", [(1, True), (2, True), (3, False)])
def test_against_windows(spark, monkeypatch, seed, small):
    if not small:
        monkeypatch.setattr(dc, "BROADCAST_SHINGLES", 0)
    rows, items = case(seed)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    assert found(dc.contamination(frame(spark, rows), bench)) == plain(rows, items)


def test_without_short_items(spark):
    rows, items = case(5)
    items = [x for x in items if x[1] and len(x[1].split(" ")) >= 10]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert found(dc.contamination(frame(spark, rows), bench)) == plain(rows, items)


def test_nothing(spark):
    rows = corpus()
    none = spark.createDataFrame([], "item_id long, text string")
    assert found(dc.contamination(frame(spark, rows), none)) == plain(rows, [])
    out = dc.contamination(frame(spark, rows).where("false"), spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
