import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataprobe.llm import runs as r

from .helpers import WHITE, corpus, frame


def brute(words, least=12):
    """start, end, period of all runs by definition."""
    n, out = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            e = i + p
            smaller = any(all(words[k] == words[k + q] for k in range(s, e - q)) for q in range(1, p))
            if e - s >= max(least, 2 * p) and not smaller:
                out.append((s, e, p))
    return sorted(out, key=lambda x: (x[0], x[2]))


def got(words, least=12):
    names = {}
    ids = np.array([names.setdefault(x, len(names)) for x in words], np.int64)
    return list(zip(*(c.tolist() for c in r.find_runs(ids, len(ids), least))))


def fibonacci(k):
    a, b = ["a"], ["a", "b"]
    for _ in range(k):
        a, b = b, b + a
    return b


def thue_morse(k):
    return [str(bin(i).count("1") % 2) for i in range(1 << k)]


@pytest.mark.parametrize("least", [2, 12])
def test_runs_against_brute_force(least):
    rng = random.Random(1)
    cases = [[], ["a"], ["a"] * 2, ["a"] * 11, ["a"] * 12, ["a"] * 90, list("ab") * 6, list("abc") * 20 + list("abd") * 20, fibonacci(8)]
    for _ in range(150):
        n = rng.randrange(1, 120)
        base = [rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randrange(1, 25))]
        words = [rng.choice("abc") for _ in range(n)]
        at = rng.randrange(n)
        cases.append((words[:at] + base * rng.randrange(1, 6) + words[at:])[:160])
    for words in cases:
        assert got(words, least) == brute(words, least)


def test_documents_in_one_array_do_not_meet():
    rng = random.Random(2)
    docs = [["x"] * rng.randrange(30) + [rng.choice("xy") for _ in range(rng.randrange(80))] for _ in range(60)]
    for words, (s, e, p) in zip(docs, r.document_runs(docs)):
        assert list(zip(s.tolist(), e.tolist(), p.tolist())) == brute(words)


def test_words_that_deceive_the_quick_hash():
    words = thue_morse(13) + ["z"] + thue_morse(12) + ["a", "b", "c"] * 8
    ids = np.array([hash(x) % 1000 for x in words], np.int64)
    s, e, p = r.find_runs(ids, len(ids))
    assert all(r.holds(ids, *run) for run in zip(s.tolist(), e.tolist(), p.tolist()))
    other = r.candidates(ids, len(ids), 12, r.PrimeHashes(ids, 9))
    assert sorted(zip(*(c.tolist() for c in other))) == sorted(zip(s.tolist(), e.tolist(), p.tolist()))


def test_a_failed_verification_starts_again(monkeypatch):
    class Deceived(r.WrappingHashes):
        def same(self, a, gap, length):
            return np.ones(len(a), bool)

    monkeypatch.setattr(r, "WrappingHashes", Deceived)
    words = list("abcab") + list("xyz") * 5 + list("q") * 13
    assert got(words) == brute(words)


def test_small_pieces_give_the_same(monkeypatch):
    words = fibonacci(9) + ["z"] * 40
    want = got(words)
    monkeypatch.setattr(r, "PAIRS", 7)
    assert got(words) == want == brute(words)


def test_query_against_plain_python(spark, tmp_path):
    rows = corpus() + [(i, "la " * (i % 40) + f"x{i} y z " * (i % 9) + "end of it", "en", "s") for i in range(2000, 2060)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(repr, map(tuple, r.op12_periodic_runs(spark, str(tmp_path)).collect())))
    want = []
    for doc, text, *_ in rows:
        words = WHITE.findall(text or "")
        n = len(words)
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found_runs = brute(words)
        drop = {i for s, e, p in found_runs for i in range(s + p, e)}
        best = max(((e - s, -s, -p) for s, e, p in found_runs), default=None)
        lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in found_runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in drop)
        first = (-best[1], best[0], -best[2], 1000 * best[0] // -best[2]) if best else (None,) * 4
        want.append(repr((doc, len(found_runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())))
    assert found == sorted(want)
    assert sum("None, None, None, None" not in x for x in want) > 20


def test_empty_table_and_outputs(spark):
    df = frame(spark, corpus())
    assert r.periodic_runs(df.limit(0)).collect() == []
    one = r.periodic_runs(spark.createDataFrame([("t", "a b " * 8 + "c")], "name string, body string"), id_col="name", text_col="body").first()
    assert one["doc_id"] == "t" and one["n_words"] == 17 and one["collapsed"] == "a b c" and [tuple(x) for x in one["runs"]] == [(0, 16, 2)]


def test_very_long_text(spark):
    text = "over and over again " * 50_000 + " ".join(map(str, range(100_000)))
    row = r.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("n_words", F.to_json("runs"), F.length("collapsed")).first()
    assert tuple(row)[:2] == (300_000, '[{"start":0,"length":200000,"period":4}]')
