"""Periodic run detection in word sequences: a harmonic grid of positions with hashed prefixes.

A run of period p and length 2p or more holds two neighbouring multiples of p. So for each p the grid points 0, p, 2p, ... are
compared with their neighbours: how far words agree forwards from both, and backwards. There are n/1 + n/2 + n/3 + ... such
pairs, n log n in all, and a binary search over prefix hashes answers all of them at once in NumPy. What comes out is
verified word by word, and the runs that several pairs found are kept once, with the least period.

Documents are independent: tasks work through their own rows, those of like length in one array, without a shuffle.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_WORD, table, written

WORD = re.compile(WHITE_WORD)
#: Words of one array of short documents, and pairs of one step. Both bound memory alone; a longer document has its own array.
TOGETHER, PAIRS = 1 << 18, 1 << 18
RUN = "array<struct<start: long, length: long, period: long>>"


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers to well-spread 64-bit values (the finaliser of splitmix64)."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WrappingHashes:
    """Prefix sums of word values times powers of an odd number, modulo 2^64. Quick; words can be built that deceive it."""

    def __init__(self, ids: np.ndarray):
        self.powers = np.ones(len(ids) + 1, np.uint64)
        self.powers[1:] = 0x9E3779B97F4A7C15 | 1
        np.multiply.accumulate(self.powers, out=self.powers)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mixed(ids) * self.powers[:-1], out=self.sums[1:])

    def same(self, a: np.ndarray, gap: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of these lengths at a and a + gap have one hash."""
        left = self.sums[a + length] - self.sums[a]
        b = a + gap
        return left * self.powers[gap] == self.sums[b + length] - self.sums[b]


class PrimeHashes:
    """The same modulo two primes near 2^31, with a base drawn anew for each: slower, deceived by chance alone."""

    PRIMES = (2**31 - 1, 2**31 - 19)

    def __init__(self, ids: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        self.parts = []
        for p in self.PRIMES:
            base = int(rng.integers(1 << 20, p - 1))
            powers = np.ones(len(ids) + 1, np.uint64)
            done = 1
            while done < len(powers):
                step = min(done, len(powers) - done)
                powers[done : done + step] = powers[:step] * np.uint64(pow(base, done, p)) % np.uint64(p)
                done += step
            sums = np.zeros(len(ids) + 1, np.uint64)
            np.cumsum((mixed(ids) % np.uint64(p)) * powers[:-1] % np.uint64(p), out=sums[1:])
            self.parts.append((np.uint64(p), powers, sums % np.uint64(p)))

    def same(self, a: np.ndarray, gap: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        b = a + gap
        for p, powers, sums in self.parts:
            left = (sums[a + length] + p - sums[a]) % p
            out &= left * powers[gap] % p == (sums[b + length] + p - sums[b]) % p
        return out


def grid(n: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) of all grid points with a neighbour, periods rising, PAIRS at most at a time."""
    p = 1
    while p <= longest // 2:
        count = (n - 1) // p
        if count >= PAIRS:
            for at in range(0, count, PAIRS):
                i = np.arange(at, min(count, at + PAIRS)) * p
                yield i, np.full(len(i), p)
            p += 1
            continue
        periods = np.arange(p, min(longest // 2, p + max(1, PAIRS // max(count, 1))) + 1)
        counts = (n - 1) // periods
        cut = max(1, int(np.searchsorted(np.cumsum(counts), PAIRS, side="right")))
        periods, counts = periods[:cut], counts[:cut]
        each = np.repeat(periods, counts)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        yield (np.arange(len(each)) - first) * each, each
        p = int(periods[-1]) + 1


def reach(hashes, i: np.ndarray, p: np.ndarray, room: np.ndarray, steps: int, back: bool) -> np.ndarray:
    """For all pairs at once the number of words, room at most, on which stretches from i and i + p agree, or, going
    back, those that end before them."""
    got = np.zeros(len(i), np.int64)
    for k in range(steps - 1, -1, -1):
        more = got + (1 << k)
        ok = np.flatnonzero(more <= room)
        if len(ok):
            m = more[ok]
            good = hashes.same(i[ok] - m if back else i[ok], p[ok], m)
            got[ok[good]] = m[good]
    return got


def candidates(ids: np.ndarray, longest: int, least: int, hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end, period of stretches that no neighbour extends, length least and two periods or more, each
    (start, end) once with its least period; as the hashes have it."""
    n = len(ids)
    found = [np.zeros((0, 3), np.int64)]
    steps = max(longest, 1).bit_length()
    for i, p in grid(n, longest):
        j = i + p
        # a side that agrees on half of what is missing to a run, at least one word, must be there: probe that first
        half = (np.maximum(least - p, p) + 1) // 2
        ahead = np.flatnonzero((ids[i] == ids[j]) & (j + half <= n))
        ahead = ahead[hashes.same(i[ahead], p[ahead], half[ahead])]
        behind = np.flatnonzero((i >= half) & (ids[i - 1] == ids[j - 1]))
        behind = behind[hashes.same(i[behind] - half[behind], p[behind], half[behind])]
        pick = np.union1d(ahead, behind)
        if not len(pick):
            continue
        i, p, j = i[pick], p[pick], j[pick]
        fore = reach(hashes, i, p, n - j, steps, back=False)
        aft = reach(hashes, i, p, i, steps, back=True)
        long = aft + p + fore >= np.maximum(least, 2 * p)
        rows = np.stack([i - aft, j + fore, p], 1)[long]
        if len(rows):
            found.append(once(rows))
    s, e, p = once(np.concatenate(found)).T
    return s, e, p


def once(rows: np.ndarray) -> np.ndarray:
    """The first of the rows (start, end, period) of each start and end; periods rise."""
    order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
    rows = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[new]


def holds(ids: np.ndarray, s: int, e: int, p: int) -> bool:
    return bool((ids[s : e - p] == ids[s + p : e]).all())


def find_runs(ids: np.ndarray, longest: int, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end, period of all runs of a sequence of numbers, by start, then period. longest: an upper bound of a run's
    length. If a stretch does not hold word by word, a hash deceived: all is done again with others."""
    if len(ids) < 2:
        return (np.zeros(0, np.int64),) * 3
    for attempt in itertools.count():
        hashes = WrappingHashes(ids) if not attempt else PrimeHashes(ids, attempt)
        s, e, p = candidates(ids, longest, least, hashes)
        if all(holds(ids, *run) for run in zip(s.tolist(), e.tolist(), p.tolist())):
            order = np.lexsort((p, s))
            return s[order], e[order], p[order]


def kept_words(n: int, s: np.ndarray, e: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Which of n words stay when of each run the first period alone does."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, s + p, 1)
    np.add.at(edge, e, -1)
    return np.cumsum(edge)[:n] == 0


def _groups(counts: list[int]) -> Iterator[list[int]]:
    """Documents, by number of words, in groups of like size (within a factor of two) of TOGETHER words at most."""
    order = sorted(range(len(counts)), key=counts.__getitem__)
    group: list[int] = []
    size = 0
    for i in order:
        if group and (size + counts[i] > TOGETHER or counts[i] > 2 * max(counts[group[0]], 32)):
            yield group
            group, size = [], 0
        group.append(i)
        size += counts[i] + 1
    if group:
        yield group


def document_runs(texts: list[list[str]], least: int = 12) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """start, end, period of the runs of each document, given as its words."""
    out: list = [None] * len(texts)
    for group in _groups([len(t) for t in texts]):
        names: dict[str, int] = {}
        parts, starts, at = [], [], 0
        for g, i in enumerate(group):
            starts.append(at)
            words = texts[i]
            parts.append(np.fromiter((names.setdefault(x, len(names)) for x in words), np.int64, len(words)))
            parts.append(np.array([-2 - g]))  # stands between documents and equals no word
            at += len(words) + 1
        s, e, p = find_runs(np.concatenate(parts), max(len(texts[i]) for i in group), least)
        bounds = np.searchsorted(s, [*starts, at])
        for g, i in enumerate(group):
            a, b = bounds[g], bounds[g + 1]
            out[i] = (s[a:b] - starts[g], e[a:b] - starts[g], p[a:b])
    return out


def periodic_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period), collapsed for every row of docs.

    Words are separated by the six ASCII white spaces. A run is a stretch of words with smallest period q and length at
    least max(least, 2q) that neither neighbour extends. collapsed: the words that no run holds after its first
    q, joined by one space. A null text counts as empty: no words, no runs, collapsed ''. Repeated rows and null ids give a
    row each; other columns are ignored; an empty table gives no rows. Texts of any length are taken whole, in one task."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [WORD.findall(t) if t is not None else [] for t in batch.column("text").to_pylist()]
            found = document_runs(texts, least)
            rows = []
            for words, (s, e, p) in zip(texts, found):
                if len(s):
                    words = list(itertools.compress(words, kept_words(len(words), s, e, p)))
                rows.append(" ".join(words))
            flat = [np.concatenate([f(r) for r in found]) for f in (lambda r: r[0], lambda r: r[1] - r[0], lambda r: r[2])]
            runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in flat], ["start", "length", "period"])
            ends = np.cumsum([0, *(len(r[0]) for r in found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), runs), pa.array(rows, pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUN}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: where the crc32 h of an id is divisible by 10, all words from a on repeat the p from there, with
    a = g % n, p = 1 + floor((n - a) / (3 + g % 8)), g = floor(h / 10). Rows without id or words stay."""
    text = F.col("text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    edited = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(f"({WHITE_WORD})"))).alias("w"))
    g = F.floor(F.col("h") / 10)
    n = F.size("w")
    edited = edited.select("doc_id", "text", "w", F.when(n > 0, g % n).cast("int").alias("a"), (F.lit(3) + g % 8).alias("parts"))
    edited = edited.select("doc_id", "text", "w", "a", (F.floor((n - F.col("a")) / F.col("parts")) + 1).cast("int").alias("p"))
    word: Column = F.transform(F.col("w"), lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get(F.col("w"), F.col("a") + F.pmod(i - F.col("a"), F.col("p")))))
    return edited.select("doc_id", F.when(F.size("w") > 0, F.concat_ws(" ", word)).otherwise(text).alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every document."""
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.p")
    return written(
        rows.select(
            "doc_id", "n_runs", (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"), F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
        ),
        "runs",
    )
