"""Document fingerprints from improbable features.

A text is framed by bytes that UTF-8 never has, so that a text of any size has windows of WIDTH bytes, and those at
its ends are windows of their own. A window's entropy is the collision entropy of its bytes: equal bytes that meet
in it lower it. How rare an entropy is comes from a table counted over all windows of all documents; the rarer, the
lower the rank. A window that is the lowest of some RUN windows in a row is a feature, whatever the text's size.
Features fill Bloom filters of 2048 bits, at most 160 in one, chained for longer texts; two chains are
compared filter by filter, by the bits they share beyond those that chance would give.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import sliding_min
from .common import table
from .jaccard import LANES, U, mix64, texts_of

WIDTH = 16
RUN = 8
BITS = 2048
FULL = 160
HASHES = 5
STEP = 1 << 18
#: A window's equal pairs of bytes, from none to all.
LEVELS = WIDTH * (WIDTH - 1) // 2 + 1
FRAME = np.full(WIDTH - 1, 255, np.uint8)


def equal_pairs(b: np.ndarray) -> np.ndarray:
    """For every window of b, how many pairs of its bytes are equal: 0 at full entropy, LEVELS - 1 at none."""
    n = len(b) - WIDTH + 1
    ahead = np.zeros(len(b), np.uint8)  # of a byte: equal ones among the WIDTH - 1 after it
    behind = np.zeros(len(b), np.uint8)
    for lag in range(1, WIDTH):
        same = (b[lag:] == b[:-lag]).view(np.uint8)
        ahead[:-lag] += same
        behind[lag:] += same
    # the next window gains its last byte's pairs and loses those of the byte it leaves
    step = behind[WIDTH:].astype(np.int32) - ahead[: n - 1]
    head = sum(int((b[lag:WIDTH] == b[: WIDTH - lag]).sum()) for lag in range(1, WIDTH))
    return head + np.r_[0, np.cumsum(step)]


def rarity_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each level by how many windows have it, the rarest 0; equal counts by rising entropy, so that the windows
    at a text's ends, of few of its bytes, come before those that any edit of a short text changes. Windows of one
    byte value alone say nothing and rank last."""
    counts = counts.astype(np.int64).copy()
    counts[-1] = np.iinfo(np.int64).max
    ranks = np.empty(LEVELS, np.uint64)
    ranks[LEVELS - 1 - np.argsort(counts[::-1], kind="stable")] = np.arange(LEVELS)
    return ranks


def features(framed: np.ndarray, ranks: np.ndarray, first: int, end: int) -> np.ndarray:
    """Hashes of the windows that are lowest in one of the runs [first, end), in order of appearance."""
    out = []
    for begin in range(first, end, STEP):
        stop = min(end, begin + STEP)
        part = framed[begin : stop + RUN + WIDTH - 2]
        words = np.lib.stride_tricks.sliding_window_view(part, WIDTH)
        words = np.ascontiguousarray(words).view("<u8")
        hashes = mix64(mix64(words[:, 0] ^ LANES[0]) * LANES[1] + words[:, 1])
        # ties of rank by hash, so that the choice does not depend on the place
        key = (ranks[equal_pairs(part)] << U(56)) | (hashes >> U(8))
        low = sliding_min(key, RUN)
        at = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        flat = ranks[-1]  # as a window's rank; it fills a run only within one repeated byte
        out.append(low[at][(low[at] >> U(56)) != flat])
    return np.concatenate(out) if out else np.zeros(0, U)


def runs_of(framed: np.ndarray) -> int:
    return len(framed) - (WIDTH - 1) - (RUN - 1)


def distinct(hashes: np.ndarray) -> np.ndarray:
    _, first = np.unique(hashes, return_index=True)
    return hashes[np.sort(first)]


def feature_hashes(raw: bytes, ranks: np.ndarray) -> np.ndarray:
    """The features of a text, each once, in order of appearance; an empty text has none."""
    if not raw:
        return np.zeros(0, U)
    framed = np.concatenate([FRAME, np.frombuffer(raw, np.uint8), FRAME])
    return distinct(features(framed, ranks, 0, runs_of(framed)))


def edited_features(raw: bytes, kept: int, edited: bytes, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """feature_hashes of both texts, which agree in their first `kept` bytes: the runs there are looked at once."""
    if not raw or not edited:
        return feature_hashes(raw, ranks), feature_hashes(edited, ranks)
    a, b = (np.concatenate([FRAME, np.frombuffer(x, np.uint8), FRAME]) for x in (raw, edited))
    # the run that begins at i ends with byte i + RUN + WIDTH - 2; the first that may differ is kept + WIDTH - 1
    shared = max(0, min(kept - RUN + 1, runs_of(a), runs_of(b)))
    head = features(a, ranks, 0, shared)
    rest = [features(x, ranks, shared, runs_of(x)) for x in (a, b)]
    return tuple(distinct(np.concatenate([head, r])) for r in rest)


def level_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many windows inside the texts have each number of equal pairs, over all documents: one row of LEVELS sums a
    partition, added up."""

    def count(batches):
        total = np.zeros(LEVELS, np.int64)
        for batch in batches:
            raw, off = texts_of(batch.column(0))
            for begin in range(int(off[0]), int(off[-1]), STEP):
                part = raw[begin : min(int(off[-1]), begin + STEP + WIDTH - 1)]
                if len(part) < WIDTH:
                    continue
                inside = np.ones(len(part) - WIDTH + 1, bool)
                cuts = off[(off > begin) & (off < begin + len(part))] - begin
                for back in range(1, WIDTH):  # windows that cross into the next text
                    crossing = cuts - back
                    inside[crossing[(crossing >= 0) & (crossing < len(inside))]] = False
                total += np.bincount(equal_pairs(part)[inside], minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(range(LEVELS), pa.int32()), pa.array(total, pa.int64())], ["level", "windows"])

    out = np.zeros(LEVELS, np.int64)
    for r in docs.select(text_col).mapInArrow(count, "level int, windows long").groupBy("level").agg(F.sum("windows").alias("windows")).collect():
        out[r["level"]] = r["windows"]
    return out


def bloom_chain(hashes: np.ndarray) -> np.ndarray:
    """Filters (rows of BITS // 8 bytes) that hold the features, FULL to a filter; the last two share what is left, as a
    filter of a few features would lie within any other."""
    count = -(-len(hashes) // FULL)
    bits = np.zeros((count, BITS), np.uint8)
    row = np.arange(len(hashes)) // FULL
    if count > 1:
        tail = (count - 2) * FULL
        row[tail:] = count - 2
        row[tail + (len(hashes) - tail + 1) // 2 :] = count - 1
    for k in range(HASHES):
        bits[row, ((hashes >> U(11 * k)) & U(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def fingerprint_text(chain: np.ndarray, n: int) -> str:
    """Printable form: number of features, then each filter in base64."""
    return f"{n}:" + ",".join(base64.b64encode(f.tobytes()).decode() for f in chain)


def likeness(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> float:
    """0 to 1: the mean, over the filters of the shorter chain, of the best normalised overlap with a
    filter of the other. What chance would give is taken off: the mean overlap of filters so full, and of the
    best of m filters as many deviations as the best of m draws lies out. Two chains without features are
    alike, one without is unlike any other."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    if len(a) > len(b) or (len(a) == len(b) and na > nb):
        a, b = b, a
    x, y = np.unpackbits(a, axis=1).astype(np.float32), np.unpackbits(b, axis=1).astype(np.float32)
    ones_y = y.sum(axis=1)
    out = np.sqrt(2 * np.log(len(y) + 1))
    best = np.zeros(len(x))
    for s in range(0, len(x), 256):
        part = x[s : s + 256]
        ones = part.sum(axis=1)
        for t in range(0, len(y), 2048):
            both = part @ y[t : t + 2048].T
            full = ones_y[None, t : t + 2048] / BITS
            chance = ones[:, None] * full
            chance = chance + out * np.sqrt(chance * (1 - full))
            most = np.minimum(ones[:, None], ones_y[None, t : t + 2048])
            top = ((both - chance) / np.maximum(most - chance, 1e-6)).max(axis=1)
            best[s : s + 256] = np.maximum(best[s : s + 256], top)
    weight = x.sum(axis=1)
    return float(np.clip((best * weight).sum() / max(weight.sum(), 1.0), 0.0, 1.0))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (part, ahead, k, doc_id, text), partitioned by part and sorted: each part holds a range of
    ids in order, and at its end (ahead) the first row of the range after it; the last part ends with
    the first row of all. Ids are cut at quantiles that are ids themselves, so the row to look ahead
    to is known before the one shuffle, and no range needs another's result. Null ids come first; ids that are no
    whole numbers are ordered by their hash; rows of one id by text hash and text.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col)))  # an id that is no number
    k = F.coalesce(F.col(id_col).try_cast("long"), hashed, F.lit(-(2**63)))
    rows = docs.select(k.alias("k"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    least, cuts = rows.agg(F.min("k"), F.percentile_approx("k", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()
    if least is None:
        return rows.select(F.lit(0).alias("part"), F.lit(0).alias("ahead"), "k", F.lit(0).cast("long").alias("tie"), "doc_id", "text")
    # cuts come rounded to double: the least id at or above each is the bound, so that a row holds it
    bin_of = F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]), lambda c: c <= F.col("k")))
    found = rows.groupBy(bin_of.alias("bin")).agg(F.min("k").alias("k")).collect() if parts > 1 else []
    starts = sorted({least, *(r["k"] for r in found)})  # at most one a partition
    n = len(starts)
    bounds = F.array(*[F.lit(s).cast("long") for s in starts])
    part = F.size(F.filter(bounds, lambda s: s <= F.col("k"))) - 1
    own = F.struct(part.cast("int").alias("part"), F.lit(0).alias("ahead"))
    before = F.struct(F.pmod(part - 1, F.lit(n)).cast("int").alias("part"), F.lit(1).alias("ahead"))
    places = F.when(F.array_contains(bounds, F.col("k")), F.array(own, before)).otherwise(F.array(own))
    return (
        rows.select(F.explode(places).alias("p"), "k", F.xxhash64("text").alias("tie"), "doc_id", "text")
        .select("p.part", "p.ahead", "k", "tie", "doc_id", "text")
        .repartitionById(n, F.col("part"))
        .sortWithinPartitions("part", "ahead", "k", "tie", "text")
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    ranks come from level_counts of docs themselves unless counts, a table counted before, is given: fingerprints
    compare only under one table. The edited text: the last n_chars // 2 code points give way to as many of the next document's
    first (or all it has). A null text counts as empty. The next document is by ascending id, null
    ids first; a lone document is its own next one. Rows of one id follow each other in a fixed order.
    Other columns are ignored. An empty table gives no rows.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    ranks = rarity_ranks(level_counts(docs, text_col) if counts is None else counts)

    def digest(text: str):
        return text, text.encode("utf-8", "replace")

    def row(doc, one, nxt):
        """The result for one document, given the next, and the next's chain."""
        text, raw = one
        cut = len(text) // 2
        head = text[: len(text) - cut].encode("utf-8", "replace")
        edited = head + nxt[0][:cut].encode("utf-8", "replace")
        mine, other = edited_features(raw, len(head), edited, ranks)
        a, b = bloom_chain(mine), bloom_chain(other)
        return (doc, len(text), hashlib.sha256(edited).hexdigest(), fingerprint_text(a, len(mine)), fingerprint_text(b, len(other)), likeness(a, len(mine), b, len(other))), (a, len(mine))

    def run(batches):
        held = None  # the row that waits for the next one
        waits = None  # the result that waits for the next one's chain
        for batch in batches:
            rows = []
            for part, ahead, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "ahead", "doc_id", "text"))):
                now = digest(text)
                if held is None or held[0] != part:
                    if ahead:
                        continue
                    held, waits = (part, doc, now), None
                    continue
                if held[1] is Ellipsis:
                    continue
                found, chain = row(held[1], held[2], now)
                if waits:
                    rows.append((*waits[0], likeness(*waits[1], *chain)))
                waits = (found, chain)
                held = (part, doc, now)
                if ahead:
                    hashes = feature_hashes(now[1], ranks)
                    rows.append((*found, likeness(*chain, bloom_chain(hashes), len(hashes))))
                    held, waits = (part, Ellipsis, None), None
            if rows:
                doc, n, sha, f, fe, ne, nn = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, batch.schema.field("doc_id").type), pa.array(n, pa.int64()), pa.array(sha), pa.array(f), pa.array(fe), pa.array(ne, pa.float64()), pa.array(nn, pa.float64())],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return with_next(docs, id_col, text_col).mapInArrow(
        run,
        f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def op2_fingerprint(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    return fingerprints(table(spark, sf_dir, "documents"))
