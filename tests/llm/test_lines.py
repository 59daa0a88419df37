import re

import duckdb

from strataprobe.llm import lines

from .helpers import WHITE, corpus, frame


def plain(rows, min_docs=5, depth=3, similar=0.7, constant=0.5):
    """Kept text and dropped lines of each row, by dictionaries."""
    parsed = [[[("<*>" if re.search("[0-9]", w) else w) for w in WHITE.findall(x)] for x in (t or "").split("\n")] for _, t, _, _ in rows]
    docs, leaves = {}, {}
    for i, p in enumerate(parsed):
        for w in p:
            if w:
                leaf, sig = (len(w), tuple(w[:depth])), tuple(w)
                docs.setdefault((leaf, sig), set()).add(i)
                leaves.setdefault(leaf, set()).add(sig)
    general, gone = {}, set()
    for leaf, sigs in leaves.items():
        total = sum(len(docs[leaf, s]) for s in sigs)
        if len(sigs) > 1 and total >= min_docs:
            template = []
            for k in range(leaf[0]):
                count = {}
                for s in sigs:
                    count[s[k]] = count.get(s[k], 0) + len(docs[leaf, s])
                n, word = max((c, w) for w, c in count.items())
                template.append(word if n >= constant * total and word != "<*>" else None)
            general[leaf] = {s for s in sigs if sum(a == b for a, b in zip(s, template)) >= similar * leaf[0]}
    for leaf, sigs in leaves.items():
        many = general.get(leaf, set())
        if many and len(set().union(*(docs[leaf, s] for s in many))) >= min_docs:
            gone |= {(leaf, s) for s in many}
        gone |= {(leaf, s) for s in sigs - many if len(docs[leaf, s]) >= min_docs}
    out = []
    for (d, t, _, _), p in zip(rows, parsed):
        keep = [not w or ((len(w), tuple(w[:depth])), tuple(w)) not in gone for w in p]
        out.append((d is None, d or 0, "\n".join(x for x, k in zip((t or "").split("\n"), keep) if k), len(p), len(p) - sum(keep)))
    return sorted(out)


def rows_with_logs():
    rows = corpus(3, 50)
    for i in range(30):
        rows.append((2000 + i, f"kept line {'abcdefghij'[i % 10] * (i + 1)}\nuser {i} logged in from host{i} today\n\nshared footer line\nsession opened for name {'xyz'[i % 3]} at once", "en", "s"))
    return rows


def test_against_dictionaries(spark):
    rows = rows_with_logs()
    for how in ({}, {"min_docs": 2, "depth": 1}, {"similar": 0.5, "constant": 0.9}):
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["n_lines"], r["n_dropped"]) for r in lines.drop_recurring_lines(frame(spark, rows), **how).collect())
        assert got == plain(rows, **how)


def test_variable_fields_are_generalised(spark):
    got = {r["doc_id"]: r["text"] for r in lines.drop_recurring_lines(frame(spark, rows_with_logs())).where("doc_id >= 2000").collect()}
    assert all("logged in" not in t and "footer" not in t and "session" not in t and "kept line" in t for t in got.values())


def families(scale):
    """Lines with several fields, two families of one leaf, and one that others outnumber; each in a document of its own, beside
    a line of its own."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda k: letters[k % 26] + letters[k // 26 % 26] + letters[k // 676]
    lines = []
    for k in range(8 * scale):
        lines.append(f"2024-01-{k % 28 + 1:02} 12:30:{k % 60:02} user {name(k)} logged in from 10.0.0.{k}")
        lines.append(f"job state changed to {name(k)} by the night planner")
        lines.append(f"job state changed after {name(k)} left its old node")
    for k in range(60 * scale):
        lines.append(f"job state changed {name(k)} {name(k + 1)} {name(k + 3)} {name(k + 5)} {name(k + 7)} {name(k + 9)}")
    return [(k, f"{x}\nonly {name(k)} {name(k + 2)} says this", "en", "s") for k, x in enumerate(lines)]


def test_several_fields_and_families(spark):
    for scale in (1, 6):
        rows = families(scale)
        got = {r["doc_id"]: r["text"] for r in lines.drop_recurring_lines(frame(spark, rows)).collect()}
        for k, text, _, _ in rows:
            own = text.split("\n")[1]
            stays = k >= 24 * scale
            assert got[k] == (text if stays else own), (scale, text)


def test_families_need_documents_and_words(spark):
    few = [(k, f"job state changed to {'abcd'[k % 4] * 3} by the night planner\njob state changed to {'wxyz'[k % 4] * 3} by the night planner", "en", "s") for k in range(4)]
    unlike = [(k + 10, f"one two three {'pqrstuv'[k] * 4} {'ghijklm'[k] * 5} six", "en", "s") for k in range(7)]
    got = {r["doc_id"]: r["text"] for r in lines.drop_recurring_lines(frame(spark, few + unlike)).collect()}
    assert got == {d: t for d, t, _, _ in few + unlike}


def test_sql(spark):
    rows = rows_with_logs()
    documents = frame(spark, rows, clash=False).toPandas()  # noqa: F841  DuckDB finds it by name
    key = lambda r: (-1 if r[0] is None or r[0] != r[0] else int(r[0]), *tuple(r)[1:])  # noqa: E731  pandas makes a null id NaN
    out = lines.drop_recurring_lines(frame(spark, rows)).selectExpr("doc_id", "n_lines", "n_dropped", "sha2(text, 256)")
    assert sorted(map(key, out.collect())) == sorted(map(key, duckdb.sql(lines.OP6_SQL).fetchall()))


def test_native_and_empty(spark):
    out = lines.drop_recurring_lines(frame(spark, corpus()).where("false"))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
