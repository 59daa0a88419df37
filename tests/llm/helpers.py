"""Small documents with the cases every operator must take, and plain versions to hold results against."""

import random
import re

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASH = "size long, taken long, rid long, th long, sid long, part int, shard_id string, score double"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + ("." if rng.random() < 0.1 else "") for _ in range(n))


def corpus(seed=1, n=60):
    """Rows (doc_id, text, lang, source): prose, exact and near copies, shared passages, repetition, nulls,
    empty and short texts, a repeated row, a null id."""
    rng = random.Random(seed)
    rows = []
    passage = prose(rng, 80, 5000)
    for i in range(n):
        text = prose(rng, rng.choice([3, 12, 60, 200]), 5000)
        if i % 5 == 1 and rows and rows[-1][1]:
            words = rows[-1][1].split(" ")
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = "edited"
            text = " ".join(words)
        if i % 11 == 3:
            text = text + "\n" + passage + "\nÉté " + text
        if i % 13 == 5:
            text = rows[i // 2][1]
        if i % 17 == 7:
            text = "again and " * 120
        rows.append((i * 3, text, "en", f"s{i % 4}" if i % 9 else None))
    rows += [(1001, None, None, None), (1002, "", "en", "s0"), (1003, " \n\t", "en", "s1"), (1004, "One", "en", "s1"), (1005, "one two THREE", "en", "s1"), (1006, "é" * 300 + " " + "漢" * 200, "fr", "s2")]
    rows += [rows[4], (None, rows[2][1], "en", "s0"), (1007, "x" * 50_000 + " end", "en", "s3")]
    return rows


def frame(spark, rows, clash=True):
    df = spark.createDataFrame([(d, t, lang, s, len(t) if t is not None else None) for d, t, lang, s in rows], SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASH.split(", ")])
    return df.repartition(5)


def union_find(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
