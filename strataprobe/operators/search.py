"""Exact search for many identifiers: counts, totals and bounded samples from one pass over the lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import category_rank
from ..functions.text import excerpt_around, occurrences

#: Identifiers up to which a search is column expressions.
FEW = 64
#: Bits at most of the sketch of identifiers that a table holds; a full one only lets more candidates through.
SKETCH_BITS = 26
#: Bytes of lines hashed at a time.
HASHED = 1 << 21
LINE_END = r"\r\n|\n|\r"


def numbered_lines(texts: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """path, line_no from 1, line: any line end counts; an ending one opens no further line."""
    parts = F.split(F.col(text_col), LINE_END)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return texts.select(F.col(path_col).alias("path"), F.posexplode(parts).alias("at", "line")).select("path", (F.col("at") + 1).alias("line_no"), "line")


def line_matches(lines: DataFrame, identifiers: list[str], ignore_case: bool = False, few: int = FEW) -> DataFrame:
    """lines(path, line_no, line) -> identifier, path, line_no, line, occurrences (from left to right, none over another of the
    same identifier). Every identifier is tested while its line is at hand: no join, and lines without a match go before any
    shuffle. Up to `few` identifiers are column expressions; more are one automaton, whose work a line does not grow with them."""
    wanted = list(dict.fromkeys(identifiers))
    if not wanted or any(not x for x in wanted):
        raise ValueError("identifiers must be given and not empty")
    if len(wanted) > few:
        return automaton_matches(lines, wanted, ignore_case)
    fold = F.lower if ignore_case else (lambda c: c)
    some = F.lit(False)
    for x in wanted:
        some = some | F.contains(fold(F.col("line")), F.lit(x.lower() if ignore_case else x))
    ids = F.filter(F.array(*[F.lit(x) for x in wanted]), lambda x: F.contains(fold(F.col("line")), fold(x)))
    return lines.where(some).select("path", "line_no", "line", F.explode(ids).alias("identifier")).withColumn(
        "occurrences", occurrences(fold(F.col("line")), fold(F.col("identifier")))
    )


def automaton_matches(lines: DataFrame, wanted: list[str], ignore_case: bool = False) -> DataFrame:
    """line_matches() by an Aho-Corasick automaton, built once a task: one pass over a line finds all identifiers."""
    spelled: dict[str, list[str]] = {}
    for x in wanted:
        spelled.setdefault(x.lower() if ignore_case else x, []).append(x)

    def run(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for key in spelled:
            machine.add_word(key, key)
        machine.make_automaton()
        for batch in batches:
            at, names, counts = [], [], []
            for i, line in enumerate(batch.column("line").to_pylist()):
                if line is None:
                    continue
                found: dict[str, list[int]] = {}  # count, and the first place that is free
                for end, key in machine.iter(line.lower() if ignore_case else line):
                    seen = found.setdefault(key, [0, 0])
                    if end - len(key) + 1 >= seen[1]:
                        seen[0] += 1
                        seen[1] = end + 1
                for key, (n, _) in found.items():
                    for x in spelled[key]:
                        at.append(i), names.append(x), counts.append(n)
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *taken.columns, pa.array(counts, pa.int32())], ["identifier", *taken.schema.names, "occurrences"])

    kept = lines.select("path", "line_no", "line")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"identifier string, {schema}, occurrences int").select("path", "line_no", "line", "identifier", "occurrences")


FACTOR = 0x9E3779B97F4A7C15
CODES = np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)


def _column(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends) of a column of texts; the text i lies from ends[i] to ends[i + 1]."""
    texts = texts.cast(pa.large_binary())
    _, ends, raw = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, powers) by which rolled() hashes any stretch of data, modulo 2^64."""
    step = np.full(len(data) + 1, FACTOR, np.uint64)
    step[0] = 1
    back = np.full(len(data), pow(FACTOR, -1, 2**64), np.uint64)
    back[:1] = 1
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(CODES[data] * np.cumprod(back))]), np.cumprod(step)


def rolled(sums: np.ndarray, powers: np.ndarray, at: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    return (sums[ends] - sums[at]) * powers[at]


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(hashes * np.uint64(f)) >> np.uint64(64 - bits) for f in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def sketch_of(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of ids(identifier), a byte for eight places; its pieces are put together by many tasks."""
    piece = max(bits - 7, 3)

    def places(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 10_000):
                data, ends = _column(batch.column("identifier").slice(i, 10_000))
                found = np.concatenate(_places(rolled(*_sums(data), ends[:-1], ends[1:]), bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found >> piece), pa.array(found & ((1 << piece) - 1))], ["piece", "place"])

    def packed(key, table):
        held = np.zeros(1 << piece, bool)
        held[table.column("place").to_numpy()] = True
        return pa.table({"piece": pa.array([key[0].as_py()], pa.int64()), "held": pa.array([np.packbits(held).tobytes()], pa.binary())})

    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (piece - 3)
    for r in ids.mapInArrow(places, "piece long, place long").groupBy("piece").applyInArrow(packed, "piece long, held binary").toLocalIterator():
        out[r["piece"] * size : (r["piece"] + 1) * size] = np.frombuffer(bytes(r["held"]), np.uint8)
    return out


def matches_of(lines: DataFrame, identifiers: DataFrame) -> DataFrame:
    """line_matches() for the identifiers(identifier) of a table of any length. Every stretch of a line that is as long as
    some identifier is held against a sketch of bounded size; those that pass are candidates, and a join by their whole text tells
    which are identifiers. So no task and no driver holds the identifiers, and work grows with the lines and the distinct lengths."""
    ids = identifiers.select("identifier").where("identifier is not null").distinct()
    if ids.where("identifier = ''").take(1):
        raise ValueError("identifiers must not be empty")
    sizes = {r["size"]: r["n"] for r in ids.groupBy(F.octet_length("identifier").alias("size")).agg(F.count("*").alias("n")).collect()}
    bits = min(SKETCH_BITS, max(16, (16 * sum(sizes.values())).bit_length()))
    shared = lines.sparkSession.sparkContext.broadcast(sketch_of(ids, bits))

    def candidates(column: pa.Array, at: list, texts: list, counts: list, first: int) -> None:
        data, ends = _column(column)
        sums, powers = _sums(data)
        sketch = shared.value
        for size in sizes:
            if size > len(data):
                continue
            likely = np.ones(len(data) - size + 1, bool)
            for place in _places(rolled(sums, powers, slice(0, len(likely)), slice(size, None)), bits):
                likely &= (sketch[place >> np.uint64(3)] >> (7 - (place & np.uint64(7))).astype(np.uint8)) & 1 == 1
            begin = np.flatnonzero(likely)
            line = np.searchsorted(ends, begin, "right") - 1
            inside = begin + size <= ends[line + 1]
            found: dict[tuple[int, bytes], list[int]] = {}  # count, and the first place that is free
            for i, b in zip(line[inside].tolist(), begin[inside].tolist()):
                seen = found.setdefault((i, data[b : b + size].tobytes()), [0, 0])
                if b >= seen[1]:
                    seen[0] += 1
                    seen[1] = b + size
            for (i, raw), (n, _) in found.items():
                try:
                    texts.append(raw.decode("utf-8"))
                except UnicodeDecodeError:  # it begins or ends within a code point, so it is no identifier
                    continue
                at.append(first + i), counts.append(n)

    def run(batches):
        for batch in batches:
            column = batch.column("line")
            bytes_to = np.cumsum(np.diff(_column(column)[1])) if batch.num_rows else np.zeros(0, np.int64)
            at, texts, counts, i = [], [], [], 0
            while i < batch.num_rows:
                done = bytes_to[i - 1] if i else 0
                k = max(i + 1, int(np.searchsorted(bytes_to, done + HASHED, "right")))
                candidates(column.slice(i, k - i), at, texts, counts, i)
                i = k
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *taken.columns, pa.array(counts, pa.int32())], ["identifier", *taken.schema.names, "occurrences"])

    kept = lines.select("path", "line_no", "line")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    found = kept.mapInArrow(run, f"identifier string, {schema}, occurrences int")
    return found.join(ids, "identifier", "left_semi").select("path", "line_no", "line", "identifier", "occurrences")


def match_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("identifier", "path").agg(
        F.sum("occurrences").alias("match_count"),
        F.count("*").alias("matching_lines"),
        F.min("line_no").alias("first_line"),
        F.max("line_no").alias("last_line"),
    )


def match_samples(matches: DataFrame, per_file: int = 3, width: int = 500, ignore_case: bool = False) -> DataFrame:
    """The first lines of each identifier and file, as excerpts around the match."""
    first = Window.partitionBy("identifier", "path").orderBy("line_no")
    out = matches.withColumn("sample_no", F.row_number().over(first)).where(F.col("sample_no") <= per_file)
    return out.select("identifier", "path", "line_no", "sample_no", excerpt_around(F.col("line"), F.col("identifier"), width, ignore_case).alias("excerpt"))


def match_totals(counts: DataFrame) -> DataFrame:
    """counts(identifier, path, category, match_count) -> one row an identifier and category."""
    return counts.groupBy("identifier", "category").agg(
        F.sum("match_count").alias("occurrences"), F.count_distinct("path").alias("files")
    )


def ranked_matches(counts: DataFrame) -> DataFrame:
    """By identifier, then categories most telling first, then count."""
    return counts.orderBy("identifier", category_rank(F.col("category")), F.col("match_count").desc(), "path")
