"""Exact removal of repeated byte strings by a partitioned suffix sort.

Content anchors (anchors.py) bring together the places where equal windows of `length` bytes can lie.
Regions that are equal as a whole need no sorting. Where regions of one anchor differ, their strings
to the right of the anchor, and to its left, are suffix-sorted deep-shallow: multikey quicksort to a
shallow depth, then blind tries for the groups that still agree. Common prefixes of neighbours then
tell which windows of a region also lie in another. An anchor with many regions is dealt by what stands on
either side of it; where that still leaves many together, their windows are dealt one by one.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchors_of
from .common import table, written
from .jaccard import SEED, U, bloom_filter, in_bloom, mix64, texts_of

SHALLOW = 32
WORD = 8
ANCHORS_A_TASK = 1_000_000
#: Differing regions of one anchor from which they are dealt again by their surroundings.
HOT_REGIONS = 2000
#: Regions of one such place from which their windows are told apart one by one: no task sorts more.
HOT_PLACE = 2000
#: Texts of one anchor from which its records are dealt by region too, and of how many texts one is counted for this.
HOT_ANCHOR, SAMPLE = 100_000, 64
#: Mark of a record whose region is known to be repeated.
DONE = 255


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


class BlindTrie:
    """Compacted trie that stores branch depths only: a string goes down by its branching bytes,
    unseen bytes in between, and one comparison with the leaf it meets gives its true place."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: list | None = None  # leaf: [-1, [ids]]; branch: [depth, {byte: node}]

    def add(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [-1, [i]]
            return
        node = self.root
        while node[0] >= 0:
            c = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        leaf = self.strings[node[1][0]]
        depth = common_prefix(s, leaf)
        if depth == len(s) == len(leaf):
            node[1].append(i)
            return
        parent, byte, node = None, None, self.root
        while node[0] >= 0 and node[0] < depth:
            parent, byte = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][byte]
        mine = s[depth] if depth < len(s) else -1
        if node[0] == depth:
            node[1][mine] = [-1, [i]]
            return
        theirs = leaf[depth] if depth < len(leaf) else -1
        branch = [depth, {theirs: node, mine: [-1, [i]]}]
        if parent is None:
            self.root = branch
        else:
            parent[1][byte] = branch

    def order(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                out.extend(node[1])
            else:
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
        return out


def deep_shallow_sort(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """(order, common): the strings' sorted order, and each one's common prefix with the one before."""
    order: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            order.extend(group)
        elif depth >= SHALLOW:
            trie = BlindTrie(strings)
            for i in group:
                trie.add(i)
            order.extend(trie.order())
        else:
            words = [strings[i][depth : depth + WORD] for i in group]
            pivot = sorted(words[:: max(1, len(words) // 7)])[len(words[:: max(1, len(words) // 7)]) // 2]
            less = [i for i, w in zip(group, words) if w < pivot]
            same = [i for i, w in zip(group, words) if w == pivot]
            more = [i for i, w in zip(group, words) if w > pivot]
            if more:
                stack.append((more, depth))
            stack.append((same, depth + WORD if len(pivot) == WORD else SHALLOW))
            if less:
                stack.append((less, depth))
    common = [0] + [common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]
    return order, common


def shared_windows(regions: list[tuple[bytes, int]], length: int) -> list[list[tuple[int, int]]]:
    """For each region (bytes, offset of the anchor): ranges of window starts, within the region, of windows that
    another region holds at the same place from its anchor.

    Regions agree x bytes to the left and y to the right of their anchors; their common windows start in
    [at - x, at + y - length]. Blocks of the left order merge by falling x; in a merge each member
    of the smaller block meets its neighbours in the right order, the best it can meet. That is m log m
    meetings for m regions, not all pairs.
    """
    found: list[list[tuple[int, int]]] = [[] for _ in regions]
    lefts = [body[:at][::-1] for body, at in regions]
    rights = [body[at:] for body, at in regions]
    right_order, _ = deep_shallow_sort(rights)
    rank = [0] * len(regions)
    for k, i in enumerate(right_order):
        rank[i] = k
    left_order, left_common = deep_shallow_sort(lefts)
    block = list(range(len(regions)))  # of a place in the left order
    members = {k: [rank[i]] for k, i in enumerate(left_order)}

    def root(k: int) -> int:
        while block[k] != k:
            block[k] = block[block[k]]
            k = block[k]
        return k

    for k in sorted(range(1, len(regions)), key=lambda k: -left_common[k]):
        x = left_common[k]
        a, b = root(k - 1), root(k)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large = members[a]
        for r in members.pop(b):
            p = bisect_left(large, r)
            i = right_order[r]
            for q in (p - 1, p):
                if 0 <= q < len(large):
                    j = right_order[large[q]]
                    y = common_prefix(rights[i], rights[j])
                    if x + y >= length:
                        for e in (i, j):
                            at = regions[e][1]
                            found[e].append((at - x, at + y - length))
            large.insert(p, r)
        block[b] = a
    return found


def merge_spans(th: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of [lo, end) text by text."""
    order = np.lexsort((lo, th))
    th, lo, end = th[order], lo[order], end[order]
    if not len(th):
        return th, lo, end
    new_text = np.r_[True, th[1:] != th[:-1]]
    base = np.cumsum(new_text).astype(np.int64) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(base + end)
    new = np.r_[True, (base + lo)[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(th)] - 1
    return th[first], lo[first], reach[last] - base[last]


def _windows_met(regions: DataFrame, length: int) -> DataFrame:
    """gram, region, a, z: the first and last window of a region (gram, region, at, first, last, body) that another region
    of its anchor holds at the same place from it. All windows of a region hold its anchor, so that what they
    cover is one stretch. Nothing meets but hashes: a window's holders are only counted, map side first."""
    each = F.explode(F.sequence("first", "last")).alias("a")
    windows = regions.select("gram", "region", "at", "body", each)
    key = F.xxhash64("gram", F.col("at") - F.col("a"), F.substr("body", F.col("a") + 1, F.lit(length)))
    windows = windows.select("gram", "region", "a", key.alias("window"))
    shared = windows.groupBy("window").agg(F.min("region").alias("least"), F.max("region").alias("most")).where("least <> most").select("window")
    met = windows.join(shared, "window")
    return met.groupBy("gram", "region").agg(F.min("a").cast("long").alias("a"), F.max("a").cast("long").alias("z"))


def combined(rec: np.ndarray) -> np.ndarray:
    """Records of one batch: where a region lies in several places, these are DONE, and one record of the region says
    that it is repeated. So a region that every text holds sends one record a batch to where its like meet."""
    rec["times"] = 1
    rec = rec[np.lexsort((rec["lo"], rec["th"], rec["region"], rec["gram"]))]
    same = (rec["gram"][1:] == rec["gram"][:-1]) & (rec["region"][1:] == rec["region"][:-1])
    rec = rec[np.r_[True, ~(same & (rec["th"][1:] == rec["th"][:-1]) & (rec["lo"][1:] == rec["lo"][:-1]))]]
    same = (rec["gram"][1:] == rec["gram"][:-1]) & (rec["region"][1:] == rec["region"][:-1])
    first = np.flatnonzero(np.r_[True, ~same])
    size = np.diff(np.r_[first, len(rec)])
    told = rec[first[size > 1]].copy()
    told["times"] = 2
    rec["times"][np.repeat(size > 1, size)] = DONE
    return np.concatenate([rec, told])


def _frequent_anchors(read: DataFrame, length: int, gram: int) -> np.ndarray:
    """Anchors (hashes, sorted) that about HOT_ANCHOR texts or more hold: those of one text in SAMPLE, by hash, are counted. Their number
    is bounded by the anchors of the corpus over HOT_ANCHOR."""

    def count(batches):
        for batch in batches:
            raw, off = texts_of(batch.column("text"))
            found = [np.unique(anchors_of(raw[a:z], length, gram)["gram"]) for a, z in zip(off[:-1], off[1:]) if z - a >= length]
            if found:
                grams, times = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(times.astype(np.int64))], ["gram", "n"])

    some = read.where(F.pmod(F.xxhash64("doc_id", "th"), F.lit(SAMPLE)) == 0).select("text")
    counts = some.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    hot = counts.where(F.col("n") * SAMPLE >= HOT_ANCHOR).select("gram").toPandas()["gram"].to_numpy(np.int64)
    return np.sort(hot.view(np.uint64))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes; null if nothing was removed or all)
    for every row of docs.

    A byte goes if some `length`-byte string over it starts in another place of any text as well, the
    same text included; strings are those of the input. Null and empty texts have no bytes; shorter
    texts than `length` keep all; equal rows remove each other entirely. Other columns are ignored. Texts are known by
    64-bit hash and size; regions by 64-bit hashes of their bytes within anchors of equal hash.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    slim = written(
        read.select("doc_id", "th", F.octet_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha")), "texts"
    )
    copies = slim.groupBy("th", "n").agg(F.count("*").alias("copies"))
    total = slim.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * 2 // (length - gram) // ANCHORS_A_TASK) + 1)
    rec_type = np.dtype([("gram", "<u8"), ("region", "<u8"), ("th", "<i8"), ("lo", "<u4"), ("at", "<u2"), ("span", "<u2"), ("times", "u1")])
    # An anchor of very many texts is dealt by anchor and region. Which these are a sample of texts tells; it decides where
    # records meet, not what comes of them.
    frequent = spark.sparkContext.broadcast(_frequent_anchors(read, length, gram))

    def anchored(batch, seen):
        raw, off = texts_of(batch.column("text"))
        for th, a, z in zip(batch.column("th").to_pylist(), off[:-1], off[1:]):
            if z - a >= length and (th, int(z - a)) not in seen:  # further copies tell nothing new
                seen.add((th, int(z - a)))
                yield th, raw[a:z], anchors_of(raw[a:z], length, gram)

    def deal(batches):
        seen: set = set()
        for batch in batches:
            got = []
            for th, _, found in anchored(batch, seen):
                r = np.zeros(len(found), rec_type)
                for f in ("gram", "region", "lo", "at", "span"):
                    r[f] = found[f]
                r["th"] = th
                got.append(r)
            if not got:
                continue
            rec = combined(np.concatenate(got))
            key = np.where(np.isin(rec["gram"], frequent.value), mix64(rec["gram"] ^ mix64(rec["region"])), rec["gram"])
            key = np.where(rec["times"] == DONE, rec["th"].view(U), key)
            part = (mix64(key + SEED) % U(tasks)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, rec = part[order], rec[order]
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            ends = np.r_[cut[1:], len(part)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[cut], pa.int32()), pa.array([rec[a:z].tobytes() for a, z in zip(cut, ends)], pa.binary())], ["part", "blob"]
            )

    columns = ["edge", "gram", "region", "th", "lo", "end"]

    def meet(batches):
        kept = [np.frombuffer(blob, rec_type) for batch in batches for blob in batch.column("blob").to_pylist()]
        if not kept:
            return
        rec = np.concatenate(kept)
        kept.clear()
        done = rec[rec["times"] == DONE]
        if len(done):
            done = done[np.lexsort((done["lo"], done["th"]))]
            th, lo, end = merge_spans(done["th"], done["lo"].astype(np.int64), done["lo"].astype(np.int64) + done["span"] + length)
            zero = np.zeros(len(th), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (zero.astype(np.int32), zero, zero, th, lo, end)], columns)
            rec = rec[rec["times"] != DONE]
        if not len(rec):
            return
        rec = rec[np.lexsort((~rec["times"], rec["lo"], rec["th"], rec["region"], rec["gram"]))]
        g, r = rec["gram"], rec["region"]
        new_region = np.r_[True, (g[1:] != g[:-1]) | (r[1:] != r[:-1])]
        place = np.r_[True, new_region[1:] | (rec["th"][1:] != rec["th"][:-1]) | (rec["lo"][1:] != rec["lo"][:-1])]
        rec, new_region = rec[place], new_region[place]
        g = rec["gram"]
        first = np.flatnonzero(new_region)
        times = np.add.reduceat(rec["times"].astype(np.int64), first)
        rows = np.diff(np.r_[first, len(rec)])
        full = rec[np.repeat(times > 1, rows)]
        th, lo, end = merge_spans(full["th"], full["lo"].astype(np.int64), full["lo"].astype(np.int64) + full["span"] + length)
        if len(th):
            zero = np.zeros(len(th), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (zero.astype(np.int32), zero, zero, th, lo, end)], columns)
        one = rec[first]
        new_gram = np.r_[True, one["gram"][1:] != one["gram"][:-1]]
        begin = np.flatnonzero(new_gram)
        size = np.diff(np.r_[begin, len(one)])
        mixed = np.repeat(size > 1, size) | np.isin(one["gram"], frequent.value)
        one, times = one[mixed], times[mixed]
        if len(one):  # edge 1: the region's place takes what the sort finds; 2: the region is only compared with
            cols = (np.where(times > 1, 2, 1).astype(np.int32), one["gram"].view(np.int64), one["region"].view(np.int64), one["th"], one["lo"].astype(np.int64), one["lo"].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], columns)

    dealt = read.select("th", "text").mapInArrow(deal, "part int, blob binary")
    met = written(dealt.repartitionById(tasks, F.col("part")).mapInArrow(meet, "edge int, gram long, region long, th long, lo long, end long"), "met")
    edges = met.where("edge > 0")

    wanted = bloom_filter(edges, ["gram", "region"])
    # Regions that share windows agree on half the room beyond the anchor on its left or its right, so a string
    # that very many texts hold can be dealt by these halves; what the filter lets in too much is dealt so in vain.
    hot = bloom_filter(edges.groupBy("gram").count().where(F.col("count") > HOT_REGIONS).select("gram"), ["gram"])
    half = (length - gram) // 2

    def bring(batches):
        seen: set = set()
        sent: set = set()
        for batch in batches:
            rows = []
            for _, raw, found in anchored(batch, seen):
                if not len(found):
                    continue
                for f in found[in_bloom(wanted.value, [found["gram"], found["region"]])]:
                    key = (int(f["gram"]), int(f["region"]))
                    if key not in sent:
                        sent.add(key)
                        lo, at = int(f["lo"]), int(f["at"])
                        body = raw[lo : lo + int(f["span"]) + length].tobytes()
                        for place, first, last in places(f["gram"], at, body):
                            rows.append((place, *key, at, first, last, body))
            if rows:
                *longs, at, first, last, body = zip(*rows)
                arrays = [pa.array(np.array(x, U).view(np.int64)) for x in longs] + [pa.array(x, pa.int32()) for x in (at, first, last)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(body, pa.binary())], ["place", "gram", "region", "at", "first", "last", "body"])

    def places(g, at: int, body: bytes) -> list[tuple[int, int, int]]:
        """Where a region meets others, with its anchor or with its anchor and either half, and the first and last
        of its windows that can be met there."""
        span = len(body) - length
        if not in_bloom(hot.value, [np.array([g], U)])[0]:
            return [(int(g), 0, span)]
        out = []
        if at >= half:
            out.append((b"L" + int(g).to_bytes(8, "little") + body[at - half : at], 0, min(span, at - half)))
        if span > at - half:
            out.append((b"R" + int(g).to_bytes(8, "little") + body[at : at + length - half + 1], max(0, at - half + 1), span))
        return [(int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little"), a, z) for x, a, z in out]

    def sort(batches):
        group: list[tuple[int, int, bytes, int]] = []
        current = None

        def flush():
            if len(group) < 2:
                return []
            windows = shared_windows([(body, at) for _, _, body, at in group], length)
            return [(g, r, a, z) for (g, r, _, _), ranges in zip(group, windows) for a, z in set(ranges)]

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["gram", "region", "a", "z"])

        for batch in batches:
            out = []
            for k, g, r, at, body in zip(*(batch.column(c).to_pylist() for c in ("place", "gram", "region", "at", "body"))):
                if k != current:
                    out += flush()
                    group, current = [], k
                if not group or group[-1][:2] != (g, r):
                    group.append((g, r, body, at))
            if out:
                yield batch_of(out)
        if out := flush():
            yield batch_of(out)

    brought = read.select("th", "text").mapInArrow(bring, "place long, gram long, region long, at int, first int, last int, body binary")
    brought = written(brought, "brought")
    meetings = brought.select("place", "gram", "region").distinct().groupBy("place").count()
    crowded = written(meetings.where(F.col("count") > HOT_PLACE).select("place"), "crowded")
    apart = brought.join(crowded, "place", "left_anti") if crowded.rows else brought
    apart = apart.select("place", "gram", "region", "at", "body").repartition(tasks, "place").sortWithinPartitions("place", "gram", "region")
    ranges = apart.mapInArrow(sort, "gram long, region long, a long, z long")
    if crowded.rows:
        ranges = ranges.unionByName(_windows_met(brought.join(crowded, "place", "left_semi"), length))
    partial = ranges.join(edges.where("edge = 1"), ["gram", "region"]).select("th", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("z") + length).alias("end"))
    spans = met.where("edge = 0").select("th", "lo", "end").unionByName(partial)
    per_text = spans.groupBy("th").agg(F.array_sort(F.collect_list(F.struct("lo", "end"))).alias("spans"))

    def join_spans(batches):
        for batch in batches:
            th, sp = [], []
            for t, s in zip(batch.column("th").to_pylist(), batch.column("spans").to_pylist()):
                out: list[list[int]] = []
                for x in s:
                    if out and x["lo"] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], x["end"])
                    else:
                        out.append([x["lo"], x["end"]])
                th.append(t)
                sp.append(np.array(out, np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(th, pa.int64()), pa.array(sp, pa.binary())], ["th", "spans"])

    per_text = written(per_text.mapInArrow(join_spans, "th long, spans binary"), "spans")
    # texts that lose some bytes: read once more, only those
    known = bloom_filter(per_text, ["th"])

    def again(batches):
        seen: set[int] = set()
        for batch in batches:
            th = batch.column("th").to_numpy()
            ok = in_bloom(known.value, [th])
            for k in np.flatnonzero(ok):
                ok[k] = int(th[k]) not in seen
                seen.add(int(th[k]))
            if ok.any():
                yield batch.filter(pa.array(ok))

    def cut(batches):
        for batch in batches:
            rows = []
            raw, off = texts_of(batch.column("text"))
            for sp, a, z in zip(batch.column("spans").to_pylist(), off[:-1], off[1:]):
                body = raw[a:z]
                keep = np.ones(len(body), bool)
                s = np.frombuffer(sp, np.int64).reshape(-1, 2)
                for lo, end in s:
                    keep[lo:end] = False
                kept = body[keep].tobytes()
                rows.append((len(body) - len(kept), len(s), hashlib.sha256(kept).hexdigest(), kept))
            removed, count, sha, kept = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("th"), batch.column("n"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())],
                ["th", "n", "removed", "count", "kept_sha", "kept"],
            )

    texts = read.select("th", "text").mapInArrow(again, "th long, text string")
    lost = (
        texts.join(per_text, "th")
        .select("th", F.octet_length("text").cast("long").alias("n"), "text", "spans")
        .mapInArrow(cut, "th long, n long, removed long, count long, kept_sha string, kept binary")
        .dropDuplicates(["th", "n"])
    )
    facts = copies.join(lost, ["th", "n"], "left").where("copies > 1 or removed > 0")
    facts = facts.select(F.col("th").alias("t"), F.col("n").alias("m"), "copies", "removed", "count", "kept_sha", "kept")
    gone = (F.col("copies") > 1) & (F.col("n") >= length)
    return slim.join(facts, (F.col("th") == F.col("t")) & (F.col("n") == F.col("m")), "left").select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(gone, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("count", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        F.when(~gone, F.col("kept")).alias("kept"),
    )


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, by strings of 400 bytes."""
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
