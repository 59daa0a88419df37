"""N-gram Jaccard join with set-relation skipping.

Sets are hashed word shingles, and a set is known by the hash of its content, so equal sets are one.
Relations between sets do the work that pairs would:

* answer level: sets that share minhashes hang on one pivot each and are verified against it. Who is
  linked to the pivot is linked to each other by way of it, and no pair inside such a component is
  looked at again; for others of the same pivot the known overlaps bound theirs from both sides.
* index level: the index holds each set's prefix in one global order (frequent shingles last), with
  positions. A list is kept in blocks of one set size, each sorted by position, so that of a block a set reads
  only the run of positions that can still give the overlap it needs, and skips the rest. Lists, and blocks, whose
  sets are all in the set's own component are skipped whole. What is read is held against the known overlaps
  and the parity bitmaps, before any set is fetched.

Every remaining pair is verified on the whole sets, so components are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, table, unwritten, written

U = np.uint64
SEED = U(0x9E3779B97F4A7C15)
LANES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], U)
CHUNK = 1 << 19
SKETCH_BITS = 21
SKETCH_PART = 1 << 16
BLOOM_BITS = 1 << 26
HASHES = 4
LIST_BLOCK = 8192
#: Pairs a task looks at together.
PAIRS_AT_ONCE = 1 << 20
GROUP = 2048
POSTINGS_A_TASK = 1_500_000
NO_ID = -(2**63)
#: Candidate pairs a set from which they are verified in rounds, and of how many rounds at most.
PAIRS_A_SET, ROUNDS = 8, 3


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(29))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


BYTE_CODE = mix64((np.arange(256, dtype=U) + U(1)) * SEED)
BYTE_CODE[65:91] = BYTE_CODE[97:123]
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^0 .. r^(n-1) and their inverses modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(CHUNK + 1, n)
        r = 0x5851F42D4C957F2D
        inv = pow(r, -1, 1 << 64)
        for base, at in ((r, 0), (inv, 1)):
            p = np.full(size, U(base), U)
            p[0] = U(1)
            _powers[at : at + 1] = [np.cumprod(p)]
    return _powers[0], _powers[1]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def word_hashes(b: np.ndarray, edge: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words in b; edge[i]: a text begins at i, so a word ends there."""
    n = len(b)
    word = IS_WORD[b]
    start, stop = word.copy(), word.copy()
    start[1:] &= ~word[:-1] if edge is None else ~word[:-1] | edge[1:n]
    stop[:-1] &= ~word[1:] if edge is None else ~word[1:] | edge[1:n]
    ws, we = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(BYTE_CODE[b] * up[:n], out=sums[1:])
    return ws, mix64((sums[we] - sums[ws]) * down[ws] + (we - ws).astype(U) * SEED)


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    runs = max(0, len(words) - width + 1)
    acc = words[:runs] * LANES[0]
    for j in range(1, width):
        acc = acc + words[j : j + runs] * LANES[j % 5] * U(2 * (j // 5) + 1)
    return mix64(acc)


def short_set(words: np.ndarray) -> np.ndarray:
    """The set of a text of fewer words than a shingle has: the whole sequence."""
    if not len(words):
        return words
    k = np.arange(len(words))
    weights = LANES[k % 5] * (k // 5 * 2 + 1).astype(U)
    return mix64((words * weights).sum(keepdims=True) + LANES[4:] * U(len(words)))


def chunk_shingles(raw: np.ndarray, off: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text in raw[off[i]:off[i+1]]."""
    base = off[0]
    b = raw[base : off[-1]]
    edge = np.zeros(len(b) + 1, bool)
    edge[off - base] = True
    ws, words = word_hashes(b, edge)
    first = np.searchsorted(ws, off - base)
    grams = gram_hashes(words, width)
    return [np.unique(grams[a : z - width + 1]) if z - a >= width else short_set(words[a:z]) for a, z in zip(first[:-1], first[1:])]


def long_shingles(b: np.ndarray, width: int) -> np.ndarray:
    """The same for one long text, read in pieces that end between words."""
    words, at = [], 0
    while at < len(b):
        end = at + CHUNK
        while end < len(b) and IS_WORD[b[end]]:  # to the end of the word
            end += 1
        words.append(word_hashes(b[at:end])[1])
        at = end
    whole = np.concatenate(words)
    return np.unique(gram_hashes(whole, width)) if len(whole) >= width else short_set(whole)


def text_sets(column, width: int):
    """Shingle sets of an Arrow string column, chunk by chunk."""
    raw, off = texts_of(column)
    at = 0
    while at < len(off) - 1:
        end = int(np.searchsorted(off, off[at] + CHUNK, "right")) - 1
        end = min(max(end, at + 1), len(off) - 1)
        if off[end] - off[at] > 2 * CHUNK:
            yield long_shingles(raw[off[at] : off[end]], width)
        else:
            yield from chunk_shingles(raw, off[at : end + 1], width)
        at = end


def set_id(u: np.ndarray) -> int:
    if not len(u):
        return 0
    with np.errstate(over="ignore"):
        h = mix64(np.array([mix64(u ^ LANES[1]).sum() * LANES[0] + mix64(u + LANES[3]).sum() + U(len(u)) * LANES[2]], U))
    return int(h.view(np.int64)[0])


def parity_bitmap(u: np.ndarray) -> bytes:
    """A bit per cell, set if an odd number of the set's hashes fall there. Cells: the least power
    of two from the set's size, 64 at least. The bits in which two sets differ are never more than
    the elements in which they differ."""
    cells = 64
    while cells < len(u):
        cells *= 2
    odd = np.bincount(((u >> U(20)) & U(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def summed(blobs: DataFrame, dtype, either: bool = False) -> dict[int, np.ndarray]:
    """blobs(part, blob): arrays added (or, either: or-ed) part by part, streamed in the tasks that own
    the parts; the driver gets one array a part, so a size fixed by the caller."""
    name = np.dtype(dtype).name

    def add(batches):
        acc: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist()):
                x = np.frombuffer(blob, name)
                if p not in acc:
                    acc[p] = x.copy() if either else x.astype(np.uint32)
                elif either:
                    acc[p] |= x
                else:
                    acc[p] += x
        if acc:
            yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int32()), pa.array([x.tobytes() for x in acc.values()], pa.binary())], ["part", "blob"])

    out_type = name if either else "uint32"
    rows = blobs.repartition(64, "part").mapInArrow(add, "part int, blob binary").collect()
    return {r["part"]: np.frombuffer(bytes(r["blob"]), out_type) for r in rows}


def order_levels(counts: np.ndarray) -> np.ndarray:
    """0 for cells of ordinary count, 1, 2, .. for each doubling beyond 8 deviations over the mean."""
    mean = counts.mean()
    over = (counts - mean) / (8 * np.sqrt(mean + 1))
    return np.where(over > 1, np.floor(np.log2(np.maximum(over, 1))) + 1, 0).astype(np.uint8)


def bloom_cells(keys: list[np.ndarray]) -> list[np.ndarray]:
    h = np.full(len(keys[0]), SEED, U)
    for k in keys:
        h = mix64(h * LANES[1] ^ np.ascontiguousarray(k).view(U))
    return [((h >> U(s)) & U(BLOOM_BITS - 1)).astype(np.int64) for s in (0, 32)]


def bloom_filter(rows: DataFrame, columns: list[str]):
    """Broadcast Bloom filter over long columns. Its size is BLOOM_BITS whatever the input; when it fills up,
    more passes it in vain and nothing is lost."""

    def mark(batches):
        bits = np.zeros(BLOOM_BITS // 8, np.uint8)
        for batch in batches:
            for cell in bloom_cells([batch.column(c).to_numpy() for c in columns]):
                np.bitwise_or.at(bits, cell >> 3, (1 << (cell & 7)).astype(np.uint8))
        for p, x in enumerate(bits.reshape(-1, SKETCH_PART)):
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["part", "blob"])

    out = np.zeros((BLOOM_BITS // 8 // SKETCH_PART, SKETCH_PART), np.uint8)
    for p, x in summed(rows.select(*columns).mapInArrow(mark, "part int, blob binary"), np.uint8, either=True).items():
        out[p] = x
    return rows.sparkSession.sparkContext.broadcast(out.reshape(-1))


def in_bloom(bloom: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    ok = np.ones(len(keys[0]), bool)
    for cell in bloom_cells(keys):
        ok &= (bloom[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
    return ok


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) -> (a, b, common, linked), by the whole sets(sid, blob)."""
    sb = sets.select(F.col("sid").alias("b"), F.col("blob").alias("blob_b"))
    sa = sets.select(F.col("sid").alias("a"), F.col("blob").alias("blob_a"))

    def compare(batches):
        for batch in batches:
            common, linked = [], []
            for x, y in zip(batch.column("blob_a").to_pylist(), batch.column("blob_b").to_pylist()):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = np.concatenate([x, y])
                both.sort()
                c = int((both[1:] == both[:-1]).sum())
                common.append(c)
                linked.append(100 * c >= percent * (len(x) + len(y) - c))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(common, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "common", "linked"]
            )

    both = pairs.join(sb, "b").join(sa, "a").select("a", "b", "blob_a", "blob_b")
    return both.mapInArrow(compare, "a long, b long, common long, linked boolean")


def runs_in_reach(tok: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int, comp: np.ndarray | None = None):
    """(i, lo, hi), block by block: set i may be similar to those in [lo, hi) and to no other set behind it in the
    block. Sorted by tok, n, pos; a block is a run of equal tok and n. At two sets' first common shingle all that
    stands before it in either is not in the other, which bounds the positions from above."""
    size = len(tok)
    if not size:
        return
    first = np.flatnonzero(np.r_[True, (tok[1:] != tok[:-1]) | (n[1:] != n[:-1])])
    block = np.repeat(np.arange(len(first)), np.diff(np.r_[first, size]))
    one = None if comp is None else np.where(np.minimum.reduceat(comp, first) == np.maximum.reduceat(comp, first), comp[first], -1)
    width = np.int64(pos.max()) + 2
    place = block * width + pos
    live = np.arange(size)
    ahead = 0
    while True:
        live = live[block[live] + ahead < len(first)]
        b = block[live] + ahead
        at = first[b]
        near = (tok[at] == tok[live]) & (percent * n[at] <= 100 * n[live])
        live, b, at = live[near], b[near], at[near]  # sizes ascend: later blocks are too large as well
        if not len(live):
            return
        need = -(-percent * (n[live] + n[at]) // (100 + percent))
        last = np.minimum(n[live] + n[at] - 2 * need - pos[live], n[at] - need)
        lo = at if ahead else live + 1
        hi = np.searchsorted(place, b * width + np.clip(last, -1, width - 2), "right")
        some = (hi > lo) & (n[live] - pos[live] >= need)
        if one is not None:
            some &= one[b] != comp[live]
        yield live[some], lo[some], hi[some]
        ahead += 1


def pair_runs(runs):
    """(i, j) of the runs, PAIRS_AT_ONCE or one set's own at a time."""
    for i, lo, hi in runs:
        count = hi - lo
        total = np.cumsum(count)
        at = 0
        while at < len(i):
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + PAIRS_AT_ONCE, "right")))
            c = count[at:end]
            skip = np.cumsum(c) - c
            yield np.repeat(i[at:end], c), np.arange(c.sum()) + np.repeat(lo[at:end] - skip, c)
            at = end


def close_pairs(rows: list[np.ndarray], bitmaps: list[bytes], percent: int):
    """Pairs within the lists (tok equal, neighbours) that may be similar: (a, b, sure), some at a time.
    rows: tok, sid, pos, comp, n, pivot, ov, pn; sorted by tok, n, pos."""
    tok, sid, pos, comp, n, pivot, ov, pn = rows
    got: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def done():
        i, j = (np.concatenate(x) for x in zip(*got))
        a, b = np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])
        order = np.lexsort((b, a))
        once = order[np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]]
        i, j, a, b = i[once], j[once], a[once], b[once]
        need = -(-percent * (n[i] + n[j]) // (100 + percent))
        keep = bitmap_distance(i, j, bitmaps) <= n[i] + n[j] - 2 * need
        sure = (pivot[i] == pivot[j]) & (ov[i] >= 0) & (ov[j] >= 0) & (ov[i] + ov[j] - pn[i] >= need)
        return a[keep], b[keep], sure[keep]

    for i, j in pair_runs(runs_in_reach(tok, n, pos, percent, comp)):
        need = -(-percent * (n[i] + n[j]) // (100 + percent))
        # what the overlaps with one pivot leave open
        same = (pivot[i] == pivot[j]) & (ov[i] >= 0) & (ov[j] >= 0)
        most = np.minimum(ov[i], ov[j]) + np.minimum(n[i] - ov[i], n[j] - ov[j])
        fit = (comp[i] != comp[j]) & (~same | (most >= need))
        if fit.any():
            got.append((i[fit], j[fit]))
            held += len(got[-1][0])
        if held > PAIRS_AT_ONCE:
            yield done()
            got, held = [], 0
    if got:
        yield done()


def partnered(tok: np.ndarray, pos: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which postings have another one in their list that sizes and positions allow; sorted by tok, n, pos."""
    size = len(tok)
    keep = np.zeros(size, bool)
    edges = np.zeros(size + 1, np.int64)
    for i, lo, hi in runs_in_reach(tok, n, pos, percent):
        keep[i] = True
        edges += np.bincount(lo, minlength=size + 1) - np.bincount(hi, minlength=size + 1)
    return keep | (np.cumsum(edges[:size]) > 0)


def bitmap_distance(i: np.ndarray, j: np.ndarray, bitmaps: list[bytes]) -> np.ndarray:
    """Differing bits; the larger bitmap is folded to the smaller's cells."""
    out = np.zeros(len(i), np.int64)
    li = np.array([len(bitmaps[k]) for k in i], np.int64)
    lj = np.array([len(bitmaps[k]) for k in j], np.int64)
    for x, y in set(zip(li.tolist(), lj.tolist())):
        for part in np.array_split(at := np.flatnonzero((li == x) & (lj == y)), max(1, len(at) * (x + y) // (1 << 24))):
            m = np.frombuffer(b"".join(bitmaps[k] for k in i[part]), U).reshape(len(part), -1)
            w = np.frombuffer(b"".join(bitmaps[k] for k in j[part]), U).reshape(len(part), -1)
            while m.shape[1] > w.shape[1]:
                m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
            while w.shape[1] > m.shape[1]:
                w = w[:, : w.shape[1] // 2] ^ w[:, w.shape[1] // 2 :]
            out[part] = np.bitwise_count(m ^ w).sum(axis=1)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, n_members, text_key, component_text for every row of docs.

    Two texts link when 100 * |A and B| >= percent * |A or B|, A and B their sets of distinct `width`-word shingles
    of ASCII-lower-cased words (fewer words: the whole sequence is the one shingle). component_id is
    the smallest doc_id that links reach. A null, empty or wordless text has no shingles and its own
    doc_id as component. Null ids are never a component's name unless it has no other. Repeated
    rows get a row each. Other columns are ignored. Shingles are compared by 64-bit hashes. Ids are numbers: they are
    cast to long, so a text that is none counts as null.

    text_key (xxhash64 of the text, null as empty) tells apart rows that share an id; component_text, null without
    shingles, is that of the component's first row by id and text_key, which so tells apart components that share
    a smallest id.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    slim_in = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"))

    def describe(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        seen: set[int] = set()
        for batch in batches:
            rows, fresh = [], []
            for u in text_sets(batch.column("text"), width):
                sid = set_id(u)
                if len(u):
                    low = [int(mix64(u ^ LANES[k]).min().view(np.int64)) for k in range(HASHES)]
                    rows.append((sid, len(u), low, parity_bitmap(u)))
                    if sid not in seen:
                        seen.add(sid)
                        fresh.append(u)
                else:
                    rows.append((0, 0, [0] * HASHES, b""))
            if fresh:
                sketch += np.bincount((np.concatenate(fresh) & U(len(sketch) - 1)).astype(np.int64), minlength=len(sketch)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(rows), pa.int32()), batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.binary()), batch.column("text_key")],
                ["part", "doc_id", "sid", "n", "low", "blob", "text_key"],
            )
        if seen:
            parts = np.minimum(sketch, 65535).astype(np.uint16).reshape(-1, SKETCH_PART)
            k = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(1, k + 1), pa.int32()), pa.nulls(k, pa.int64()), pa.array([0] * k, pa.int64()), pa.array([0] * k, pa.int64()),
                 pa.nulls(k, pa.list_(pa.int64())), pa.array([p.tobytes() for p in parts], pa.binary()), pa.nulls(k, pa.int64())],
                ["part", "doc_id", "sid", "n", "low", "blob", "text_key"],
            )

    first = written(slim_in.mapInArrow(describe, "part int, doc_id long, sid long, n long, low array<long>, blob binary, text_key long"), "sets1")
    slim = written(first.where("part = 0").select("doc_id", "sid", "n", "text_key"), "slim")
    # The sketch has a fixed size (2^SKETCH_BITS counters), whatever the input.
    counts = summed(first.where("part > 0").select("part", "blob"), np.uint16)
    if not counts:
        return slim.select(
            "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_members"),
            "text_key", F.lit(None).cast("long").alias("component_text"),
        )
    level = order_levels(np.concatenate([counts[p] for p in sorted(counts)]).astype(np.float64))
    level_b = spark.sparkContext.broadcast(level)

    classes = written(
        first.where("part = 0 and n > 0")
        .groupBy("sid")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least"),
            F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("key"),
            F.max("n").alias("n"),
            F.count("*").alias("copies"),
            F.first("low").alias("low"),
            F.first("blob").alias("bitmap"),
        ),
        "classes",
    )
    unwritten(first)
    p_total = classes.agg(F.sum(F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(p_total // POSTINGS_A_TASK) + 1)

    # answer level: sets that share a minhash meet in groups of bounded size; the one nearest to what most of
    # a group have in common is its pivot
    lows = classes.select("sid", F.posexplode("low").alias("k", "low"))
    heads = lows.groupBy("k", "low").agg(F.count("*").alias("c")).where("c > 1")
    room = F.ceil(F.col("c") / GROUP).cast("int")
    met = lows.join(heads, ["k", "low"]).select("sid", F.xxhash64("k", "low", F.pmod(F.xxhash64("sid", "k"), room)).alias("cell"))
    met = met.join(classes.select("sid", "n", "bitmap"), "sid").repartition(tasks, "cell").sortWithinPartitions("cell", "sid")

    def choose(batches):
        held: list[tuple[int, int, bytes]] = []
        current = None

        def flush():
            if len(held) < 2:
                return []
            sid, n, maps = zip(*held)
            n = np.array(n)
            size = max(set(map(len, maps)), key=[len(m) for m in maps].count)
            like = [k for k, m in enumerate(maps) if len(m) == size]
            bits = np.stack([np.unpackbits(np.frombuffer(maps[k], np.uint8)) for k in like])
            common = np.packbits(bits.mean(axis=0) > 0.5)
            off = [int(np.bitwise_count(np.frombuffer(maps[k], np.uint8) ^ common).sum()) for k in like]
            p = like[int(np.argmin(off))]
            rest = np.array([k for k in range(len(maps)) if k != p])
            apart = bitmap_distance(np.full(len(rest), p), rest, list(maps))
            need = -(-percent * (n[p] + n[rest]) // (100 + percent))
            ok = (percent * np.maximum(n[p], n[rest]) <= 100 * np.minimum(n[p], n[rest])) & (apart <= n[p] + n[rest] - 2 * need)
            return [(sid[p], sid[k], int(d)) for k, d in zip(rest[ok], apart[ok])]

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b", "apart"])

        for batch in batches:
            out = []
            for cell, sid, n, bitmap in zip(*(batch.column(c).to_pylist() for c in ("cell", "sid", "n", "bitmap"))):
                if cell != current:
                    out += flush()
                    held, current = [], cell
                held.append((sid, n, bitmap))
            if out:
                yield batch_of(out)
        if out := flush():
            yield batch_of(out)

    near = met.mapInArrow(choose, "a long, b long, apart long").groupBy("b").agg(F.min(F.struct("apart", "a")).alias("best"))
    near = written(near.select("best.a", "b"), "near")

    # 20 bytes: of a shingle's hash 48 bits tell lists apart (what they can't only adds candidates), and a
    # position over the field's range counts as its end (that only weakens a bound)
    posting = np.dtype([("hi", "<u4"), ("lo", "<u2"), ("pos", "<u2"), ("n", "<u4"), ("sid", "<i8")])

    def post(batches):
        seen: set[int] = set()
        lev = level_b.value
        mask = U(len(lev) - 1)
        for batch in batches:
            toks, sids, poss, ns, hot = [], [], [], [], []
            for u in text_sets(batch.column("text"), width):
                if not len(u) or (sid := set_id(u)) in seen:
                    continue
                seen.add(sid)
                p = prefix_length(len(u), percent)
                lv = lev[(u & mask).astype(np.int64)]
                if lv.any():
                    order = np.argsort(lv, kind="stable")[:p]
                    toks.append(u[order])
                    hot.append(lv[order] > 0)
                else:
                    toks.append(u[:p])
                    hot.append(np.zeros(p, bool))
                sids.append(np.full(p, sid, np.int64))
                poss.append(np.minimum(np.arange(p), 65535))
                ns.append(np.full(p, len(u)))
            if not toks:
                continue
            tok = np.concatenate(toks) >> U(16)
            rec = np.zeros(len(tok), posting)
            rec["hi"], rec["lo"] = tok >> U(16), tok & U(65535)
            rec["sid"], rec["pos"], rec["n"] = np.concatenate(sids), np.concatenate(poss), np.concatenate(ns)
            # a frequent shingle's list may be long: it is dealt by set, not by shingle
            key = np.where(np.concatenate(hot), mix64(tok ^ np.concatenate(sids).view(U)), mix64(tok))
            part = (key % U(tasks)).astype(np.int32) + np.where(np.concatenate(hot), tasks, 0)
            order = np.argsort(part, kind="stable")
            part, rec = part[order], rec[order]
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            ends = np.r_[cut[1:], len(part)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[cut], pa.int32()), pa.array([rec[a:z].tobytes() for a, z in zip(cut, ends)], pa.binary())], ["part", "blob"]
            )

    def lists(batches):
        """Postings that another one in their list may be similar to, by sizes and positions; frequent shingles'
        as they come."""
        kept: list[np.ndarray] = []

        def out(rec):
            for a in range(0, len(rec), 1 << 18):
                r = rec[a : a + (1 << 18)]
                tok = (r["hi"].astype(np.int64) << 16) | r["lo"]
                yield pa.RecordBatch.from_arrays([pa.array(tok), pa.array(r["sid"].copy()), pa.array(r["pos"].astype(np.int64))], ["tok", "sid", "pos"])

        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist()):
                rec = np.frombuffer(blob, posting)
                if part >= tasks:
                    yield from out(rec)
                else:
                    kept.append(rec)
        if kept:
            rec = np.concatenate(kept)
            kept.clear()
            tok = (rec["hi"].astype(np.int64) << 16) | rec["lo"]
            order = np.lexsort((rec["pos"], rec["sid"], tok))
            rec, tok = rec[order], tok[order]
            new = np.r_[True, (tok[1:] != tok[:-1]) | (rec["sid"][1:] != rec["sid"][:-1])]
            rec, tok = rec[new], tok[new]
            order = np.lexsort((rec["pos"], rec["n"], tok))
            rec, tok = rec[order], tok[order]
            yield from out(rec[partnered(tok, rec["pos"].astype(np.int64), rec["n"].astype(np.int64), percent)])

    posts = slim_in.select("text").mapInArrow(post, "part int, blob binary")
    kept_lists = written(posts.repartitionById(tasks, F.col("part") % tasks).mapInArrow(lists, "tok long, sid long, pos long"), "lists")
    live = kept_lists.groupBy("tok", "sid").agg(F.min("pos").alias("pos"))

    def fetched(pairs: DataFrame) -> DataFrame:
        """Whole sets (sid, blob) of the pairs' ends: the texts are read again, but only documents in a
        Bloom filter of fixed size (BLOOM_BITS) are cut into shingles."""
        ends = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
        ends = ends.join(classes.select("sid", "key"), "sid")
        bloom = bloom_filter(ends, ["key"])
        exact = bloom_filter(ends, ["sid", "key"])

        def fetch(batches):
            seen: set[int] = set()
            for batch in batches:
                ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
                hit = in_bloom(bloom.value, [ids])
                found = []
                if hit.any():
                    for doc, u in zip(ids[hit], text_sets(batch.column("text").filter(pa.array(hit)), width)):
                        if len(u) and (sid := set_id(u)) not in seen and in_bloom(exact.value, [np.array([sid]), np.array([doc])])[0]:
                            seen.add(sid)
                            found.append((sid, u.tobytes()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())], ["sid", "blob"])

        return written(slim_in.mapInArrow(fetch, "sid long, blob binary"), "wholesets")

    sets = fetched(near)
    tried = written(verify(near, sets, percent), "tried")
    unwritten(sets)
    links = tried.where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    known = written(components(links), "known")

    # index level: lists that hold sets of more than one component
    size_of = classes.select(F.col("sid").alias("pivot"), F.col("n").alias("pn"))
    overlap = tried.select(F.col("a").alias("pivot"), F.col("b").alias("sid"), F.col("common").alias("ov")).distinct().join(size_of, "pivot")
    of_set = known.select(F.col("node").alias("sid"), F.col("component").alias("comp"))
    placed = live.join(of_set, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    mixed = placed.groupBy("tok").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("len")).where("c0 <> c1")
    blocks = F.ceil(F.col("len") / LIST_BLOCK).cast("int")
    mixed = mixed.select("tok", blocks.alias("blocks"))
    mine = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    # a long list is dealt in blocks, each pair of blocks a task's work
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("mine")) * F.col("blocks") + F.greatest(o, F.col("mine")))
    placed = placed.join(mixed, "tok").withColumn("mine", mine).withColumn("cell", F.explode(others))
    facts = classes.select("sid", "n", "bitmap").join(overlap, "sid", "left")
    placed = placed.join(facts, "sid").select(
        F.xxhash64("tok", "cell").alias("tok"), "sid", "pos", "comp", "n", F.coalesce("pivot", "sid").alias("pivot"),
        F.coalesce("ov", F.lit(-1)).alias("ov"), F.coalesce("pn", "n").alias("pn"), "bitmap",
    )
    placed = placed.repartition(tasks, "tok").sortWithinPartitions("tok", "n", "pos", "sid")
    fields = ["tok", "sid", "pos", "comp", "n", "pivot", "ov", "pn"]

    def candidates(batches):
        held: list[np.ndarray] | None = None
        maps: list[bytes] = []

        def flush(rows, bitmaps):
            for a, b, sure in close_pairs(rows, bitmaps, percent):
                for s in range(0, len(a), 1 << 18):
                    e = s + (1 << 18)
                    yield pa.RecordBatch.from_arrays([pa.array(a[s:e]), pa.array(b[s:e]), pa.array(sure[s:e])], ["a", "b", "sure"])

        for batch in batches:
            new = [batch.column(c).to_numpy() for c in fields]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            maps.extend(batch.column("bitmap").to_pylist())
            end = int(np.searchsorted(held[0], held[0][-1]))  # the last list may go on
            if end:
                yield from flush([x[:end] for x in held], maps[:end])
                held, maps = [x[end:] for x in held], maps[end:]
        if held is not None:
            yield from flush(held, maps)

    more = written(placed.mapInArrow(candidates, "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure")), "more")
    unwritten(kept_lists)
    unsure, waiting = more.where("not sure").select("a", "b"), more.rows
    links = links.union(more.where("sure").select("a", "b"))
    # Families of very many near sets: a round verifies one pair a set and leaves out those whose ends that joins, as
    # components alone are asked for. Pairs that no round joins are all verified below.
    for _ in range(ROUNDS):
        if waiting <= PAIRS_A_SET * classes.rows:
            break
        tries = written(unsure.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "tries")
        sets = fetched(tries)
        links = links.union(written(verify(tries, sets, percent).where("linked").select("a", "b"), "rest"))
        unwritten(sets)
        joined = written(components(links), "known")
        ends = [joined.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in ("a", "b")]
        left = unsure.join(tries, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left")
        unsure = written(left.where("ca is null or cb is null or ca <> cb").select("a", "b"), "unsure")
        waiting = unsure.rows
    sets = fetched(unsure)
    rest = written(verify(unsure, sets, percent).where("linked"), "rest")
    unwritten(sets)
    links = links.union(rest.select("a", "b"))
    whole = components(links)

    named = (
        classes.join(whole.select(F.col("node").alias("sid"), "component"), "sid", "left")
        .select("sid", "least", "copies", F.coalesce("component", "sid").alias("component"))
    )
    names = named.groupBy("component").agg(F.min("least").alias("first"), F.sum("copies").alias("n_members"))
    by_sid = named.join(names, "component").select(F.col("sid").alias("s"), F.col("first.doc_id").alias("component_id"), F.col("first.text_key").alias("component_text"), "n_members")
    by_sid = written(by_sid, "named")
    return slim.join(by_sid, (F.col("sid") == F.col("s")) & (F.col("n") > 0), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_members", F.lit(1)).alias("n_members"),
        "text_key",
        "component_text",
    )


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, n_members of every document: four words a shingle, similarity 0.85."""
    out = jaccard_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "n_members")
