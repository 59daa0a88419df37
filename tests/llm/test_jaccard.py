import random

import numpy as np
import pytest

from strataprobe.llm import jaccard as j

from .helpers import LOW, WHITE, corpus, frame, prose, union_find


def plain(rows, width, percent):
    sets = []
    for _, t, _, _ in rows:
        w = WHITE.findall((t or "").translate(LOW))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = union_find(len(rows), links)
    name = {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            name[r] = min(name.get(r, rows[i][0]), rows[i][0])
    return sorted(((rows[i][0] is None, rows[i][0] or 0), len(s), name.get(root[i]) if s else rows[i][0]) for i, s in enumerate(sets))


def found(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in df.collect())


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (1, 50)])
def test_against_all_pairs(spark, width, percent):
    rows = corpus(2, 120)
    assert found(j.jaccard_components(frame(spark, rows), width=width, percent=percent)) == plain(rows, width, percent)


def family(rng, size, words, edits):
    base = [f"v{rng.randrange(9000)}" for _ in range(words)]
    rows = []
    for _ in range(size):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"e{rng.randrange(99999)}"
        rows.append(" ".join(w))
    return rows


def test_families_around_the_threshold(spark, monkeypatch):
    """Near copies of which some link and some do not, among documents that share a passage."""
    rng = random.Random(11)
    shared = prose(rng, 40, 9000)
    texts = family(rng, 90, 150, 4) + family(rng, 60, 60, 3) + [prose(rng, 50, 9000) + " " + shared for _ in range(60)] + family(rng, 40, 400, 12)
    rng.shuffle(texts)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    monkeypatch.setattr(j, "LIST_BLOCK", 16)  # long lists go in blocks
    monkeypatch.setattr(j, "GROUP", 20)
    assert found(j.jaccard_components(frame(spark, rows))) == plain(rows, 4, 85)


def test_a_large_family_is_not_verified_pair_by_pair(spark, monkeypatch):
    """Pairs whose ends earlier ones join are left out; the components are those of all pairs."""
    rng = random.Random(5)
    texts = family(rng, 120, 150, 4) + family(rng, 60, 60, 3) + family(rng, 40, 400, 12)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    counts, verify = [], j.verify

    def counted(pairs, sets, percent):
        counts.append(pairs.count())
        return verify(pairs, sets, percent)

    monkeypatch.setattr(j, "verify", counted)
    monkeypatch.setattr(j, "GROUP", 4)  # small groups leave much to the lists
    found_ = {}
    for least in (10**9, 0):
        counts.clear()
        monkeypatch.setattr(j, "PAIRS_A_SET", least)
        assert found(j.jaccard_components(frame(spark, rows))) == plain(rows, 4, 85)
        found_[least] = sum(counts)
    assert found_[0] * 2 < found_[10**9], found_


@pytest.mark.parametrize("at_once", [1 << 20, 50])
def test_block_skips_lose_no_pair(monkeypatch, at_once):
    """Against a look at every pair of every list."""
    monkeypatch.setattr(j, "PAIRS_AT_ONCE", at_once)
    rng = np.random.default_rng(9)
    m, percent = 700, 85
    tok, n = rng.integers(0, 12, m), rng.integers(3, 40, m)
    pos, comp, pivot = rng.integers(0, 6, m) % n, rng.integers(0, 40, m), rng.integers(0, 5, m)
    ov = np.where(rng.random(m) < 0.6, (n * rng.random(m)).astype(np.int64), -1)
    pn = 20 + pivot
    order = np.lexsort((pos, n, tok))
    tok, n, pos, comp, pivot, ov, pn = (x[order] for x in (tok, n, pos, comp, pivot, ov, pn))
    sid = rng.permutation(m)
    maps = [j.parity_bitmap(np.zeros(0, np.uint64))] * m  # no bits, no distance
    got = {(a, b): s for x in j.close_pairs([tok, sid, pos, comp, n, pivot, ov, pn], maps, percent) for a, b, s in zip(*x)}
    want, reached = {}, np.zeros(m, bool)
    for x in range(m):
        for y in range(x + 1, m):
            need = -(-percent * (n[x] + n[y]) // (100 + percent))
            if tok[x] != tok[y] or percent * max(n[x], n[y]) > 100 * min(n[x], n[y]) or min(n[x] - pos[x], n[y] - pos[y]) < need or pos[x] + pos[y] > n[x] + n[y] - 2 * need:
                continue
            reached[[x, y]] = True
            known = pivot[x] == pivot[y] and ov[x] >= 0 and ov[y] >= 0
            if comp[x] != comp[y] and not (known and min(ov[x], ov[y]) + min(n[x] - ov[x], n[y] - ov[y]) < need):
                want[min(sid[x], sid[y]), max(sid[x], sid[y])] = bool(known and ov[x] + ov[y] - pn[x] >= need)
    assert got == want and len(want) > 100
    assert (j.partnered(tok, pos, n, percent) == reached).all()


def test_repeated_ids_are_told_apart(spark):
    """Two rows of one id, with texts of two components that both have it as their smallest."""
    a, b = prose(random.Random(1), 40, 900), prose(random.Random(2), 40, 900)
    rows = [(5, a, "en", "s"), (5, b, "en", "s"), (6, a, "en", "s"), (7, b, "en", "s"), (8, "", "en", "s"), (None, a, "en", "s")]
    got = j.jaccard_components(frame(spark, rows)).collect()
    assert {r["component_id"] for r in got if r["n_shingles"]} == {5}
    groups = {}
    for r in got:
        groups.setdefault(r["component_text"], []).append((str(r["doc_id"]), r["text_key"]))
    assert sorted(len(v) for v in groups.values()) == [1, 2, 3] and len(groups[None]) == 1


def test_nothing_to_link(spark):
    df = frame(spark, corpus())
    assert j.jaccard_components(df.where("false")).count() == 0
    assert found(j.jaccard_components(df.where("doc_id in (1001, 1002, 1003)"))) == [((False, i), 0, i) for i in (1001, 1002, 1003)]


def test_shingles_cross_no_document():
    import pyarrow as pa

    got = list(j.text_sets(pa.array(["a b c d", None, "", "d e", "a b c d", " x  y\tz\nq "]), 4))
    assert [len(x) for x in got] == [1, 0, 0, 1, 1, 1]
    assert got[0].tolist() == got[4].tolist() and got[0].tolist() != got[5].tolist()
    lone = list(j.text_sets(pa.array(["A B C D E"]), 4))[0]
    assert lone.tolist() == list(j.text_sets(pa.array(["a b c d e"]), 4))[0].tolist()


def test_bitmaps_never_hide_a_likeness():
    rng = np.random.default_rng(4)
    for n in (1, 30, 63, 64, 65, 500, 3000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(n * 0.9)], rng.integers(0, 2**63, max(1, n // 5), dtype=np.uint64)]))
        apart = j.bitmap_distance(np.array([0]), np.array([1]), [j.parity_bitmap(a), j.parity_bitmap(b)])[0]
        assert apart <= len(np.setxor1d(a, b))


def test_long_texts_in_pieces(monkeypatch):
    import pyarrow as pa

    texts = [prose(random.Random(1), 3000, 900), "w " * 900, "x" * 5000, " " * 4000, None, "a b"]
    whole = list(j.text_sets(pa.array(texts), 4))
    monkeypatch.setattr(j, "CHUNK", 700)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, j.text_sets(pa.array(texts), 4), strict=True))
