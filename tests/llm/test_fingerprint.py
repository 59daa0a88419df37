import hashlib
import random

import numpy as np

from strataprobe.llm import fingerprint as fp

from .helpers import corpus, frame, prose


def some_ranks():
    """A table as prose gives it."""
    counts = np.zeros(fp.LEVELS, np.int64)
    for i in range(20):
        b = np.frombuffer(prose(random.Random(i), 300, 5000).encode(), np.uint8)
        counts += np.bincount(fp.equal_pairs(b), minlength=fp.LEVELS)
    return fp.rarity_ranks(counts)


RANKS = some_ranks()


def chain(text, ranks=None):
    hashes = fp.feature_hashes(text.encode(), RANKS if ranks is None else ranks)
    return fp.bloom_chain(hashes), len(hashes)


def plain_pairs(b):
    return [sum(w[x] == w[y] for x in range(fp.WIDTH) for y in range(x)) for w in (b[i : i + fp.WIDTH] for i in range(len(b) - fp.WIDTH + 1))]


def plain_features(raw, ranks):
    """The lowest window of every run, in plain Python; those of one byte value left out."""
    if not raw:
        return []
    b = bytes(fp.FRAME) + raw + bytes(fp.FRAME)
    words = [b[i : i + fp.WIDTH] for i in range(len(b) - fp.WIDTH + 1)]
    h = lambda w: int(fp.mix64(fp.mix64(np.frombuffer(w[:8], "<u8") ^ fp.LANES[0]) * fp.LANES[1] + np.frombuffer(w[8:], "<u8"))[0])
    keys = [(int(ranks[p]), h(w) >> 8) for p, w in zip(plain_pairs(b), words)]
    out = []
    for i in range(len(keys) - fp.RUN + 1):
        low = min(keys[i : i + fp.RUN])
        if low[0] != fp.LEVELS - 1 and (low[0] << 56 | low[1]) not in out:
            out.append(low[0] << 56 | low[1])
    return out


def test_features_against_plain_python(monkeypatch):
    rng = random.Random(3)
    texts = ["", "a", "aa" * 40, "ab", "é", "漢字", "x" * 15, "x" * 16, "x" * 17] + [prose(rng, n, 90) for n in (1, 2, 5, 40, 90)] + [prose(rng, 300, 5000)[:n] for n in (4, 22, 30, 255, 257, 1023, 1025)]
    for step in (fp.STEP, 37):
        monkeypatch.setattr(fp, "STEP", step)
        for t in texts:
            assert [int(x) for x in fp.feature_hashes(t.encode(), RANKS)] == plain_features(t.encode(), RANKS), t
            half = t[: len(t) - len(t) // 2].encode()
            for tail in ("", "zz", "é" + t, prose(rng, 20, 90)):
                got = fp.edited_features(t.encode(), len(half), half + tail.encode(), RANKS)
                assert [list(g) for g in got] == [list(fp.feature_hashes(x, RANKS)) for x in (t.encode(), half + tail.encode())]


def test_rarity_is_counted_over_all_texts(spark):
    rows = corpus()
    want = np.zeros(fp.LEVELS, np.int64)
    for _, t, _, _ in rows:
        if t and len(t) < 5000:
            for p in plain_pairs(t.encode()):
                want[p] += 1
    df = frame(spark, [r for r in rows if len(r[1] or "") < 5000])
    assert (fp.level_counts(df) == want).all()
    ranks = fp.rarity_ranks(want)
    assert ranks[-1] == fp.LEVELS - 1 and sorted(ranks) == list(range(fp.LEVELS)) and ranks[int(np.argmax(want))] == fp.LEVELS - 2


def test_every_size_keeps_its_half():
    """Half a text in common shows, at any size, and strangers do not look alike."""
    rng = random.Random(5)
    for n in (4, 8, 16, 22, 30, 100, 255, 257, 1023, 1025, 4000):
        near, far = [], []
        for _ in range(12):
            a, b = (prose(rng, 900, 5000)[:n] for _ in range(2))
            a, b = a[::-1], b  # other beginnings
            near.append(fp.likeness(*chain(a), *chain(a[: n - n // 2] + b[: n // 2])))
            far.append(fp.likeness(*chain(a), *chain(b)))
        assert np.mean(far) < (0.2 if n < 8 else 0.12) and np.mean(near) > (0.15 if n < 100 else 0.35), (n, np.mean(near), np.mean(far))


def test_short_texts_inside_long_ones():
    rng = random.Random(6)
    for n in (60, 250, 256, 1000, 1024):
        for whole in (1100, 1200, 9000):
            long = prose(rng, 2000, 5000)[:whole]
            inner, other = long[:n], prose(rng, 400, 5000)[:n]
            assert fp.likeness(*chain(inner), *chain(long)) > 0.5, (n, whole)
            assert fp.likeness(*chain(other), *chain(long)) < 0.2, (n, whole)


def test_against_plain_python(spark):
    rows = corpus()
    docs = frame(spark, rows)
    ranks = fp.rarity_ranks(fp.level_counts(docs))
    got = fp.fingerprints(docs).collect()
    assert len(got) == len(rows)
    order = sorted(((d is not None, d or 0, t or "") for d, t, _, _ in rows), key=lambda r: (r[0], r[1]))
    ids = [o[1] if o[0] else None for o in order]
    assert len(set(ids)) == len(ids) - 1  # the repeated row
    want = set()
    for i, (known, d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][2]
        cut = len(t) // 2
        edited = t[: len(t) - cut] + nxt[:cut]
        a, b, c = chain(t, ranks), chain(edited, ranks), chain(nxt, ranks)
        want.add((d if known else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.fingerprint_text(*a), fp.fingerprint_text(*b), round(fp.likeness(*a, *b), 9), round(fp.likeness(*a, *c), 9)))
    seen = {(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got}
    assert seen == want


def test_edits_stay_near_and_strangers_far():
    rng = random.Random(5)
    near, far = [], []
    for n in (40, 80, 200, 2000):
        for _ in range(5):
            a, b = prose(rng, n, 5000), prose(rng, n, 5000)
            half = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
            near.append(fp.likeness(*chain(a), *chain(half)))
            far.append(fp.likeness(*chain(a), *chain(b)))
    assert min(near) > 0.3 and max(far) < 0.2


def test_bounds_and_identity():
    for t in ("", "a", "ab" * 6, "x" * 5000, "é" * 500):
        a = chain(t)
        assert fp.likeness(*a, *a) == 1.0 and fp.fingerprint_text(*a) == fp.fingerprint_text(*chain(t))
    assert fp.likeness(*chain(""), *chain("abc")) == 0.0
    long = chain(prose(random.Random(1), 30_000, 5000))
    assert len(long[0]) > 1 and all(np.unpackbits(f).sum() <= fp.FULL * fp.HASHES for f in long[0])


def test_lone_and_empty(spark):
    one = fp.fingerprints(frame(spark, [(7, "abcd", "en", "s")])).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert fp.fingerprints(frame(spark, corpus()).where("false")).count() == 0


def test_ids_that_doubles_cannot_hold(spark):
    for base in (2**60 + 1, -(2**63)):
        rows = [(base + 3 * i, f"text {i} " * 9, "en", "s") for i in range(120)]
        got = {r["doc_id"]: r["edited_sha256"] for r in fp.fingerprints(frame(spark, rows)).collect()}
        assert sorted(got) == [r[0] for r in rows]
        for (k, a, _, _), (_, b, _, _) in zip(rows, rows[1:] + rows[:1]):
            cut = len(a) // 2
            assert got[k] == hashlib.sha256((a[: len(a) - cut] + b[:cut]).encode()).hexdigest()
