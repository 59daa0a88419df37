import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataprobe.llm import anchors as an
from strataprobe.llm import suffixes as sx

from .helpers import corpus, frame, prose


def plain(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for b in raws:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raws:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, length, gram):
    got = sx.remove_repeats(frame(spark, rows), length=length, gram=gram).collect()
    have = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)
    want = sorted((d is None, d or 0, *w) for (d, *_), w in zip(rows, plain([t for _, t, _, _ in rows], length)))
    assert have == want


@pytest.mark.parametrize("length,gram", [(400, 200), (60, 30), (20, 4)])
def test_against_every_window(spark, length, gram):
    check(spark, [r for r in corpus(6, 60) if len(r[1] or "") < 20_000], length, gram)


@pytest.mark.parametrize("many,crowd", [(2000, 2000), (1, 2000), (1, 6), (1, 1)])
def test_passages_with_edges_of_all_kinds(spark, monkeypatch, many, crowd):
    """Regions of an anchor sorted together, by halves, by halves or windows, by windows alone."""
    monkeypatch.setattr(sx, "HOT_REGIONS", many)
    monkeypatch.setattr(sx, "HOT_PLACE", crowd)
    rng = random.Random(9)
    passage = prose(rng, 120, 9000)
    rows = []
    for i in range(40):
        a, z = sorted((rng.randrange(len(passage)), rng.randrange(len(passage))))
        rows.append((i, prose(rng, 10, 9000) + passage[a:z] + prose(rng, rng.randrange(8), 9000) + ("ab" * 60 if i % 5 == 0 else ""), "en", "s"))
    check(spark, rows, 50, 20)


def test_a_crowd_around_one_long_passage(spark):
    """Over 2,000 different regions of one anchor, most with the same 450 bytes, some with fewer than 400 of them."""
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(450))
    texts = [f"{i:05d}" * 30 + passage[: 450 if i % 50 else 395] + f"{i * 7:06d}" * 30 for i in range(2300)]
    check(spark, [(i, t, "en", "s") for i, t in enumerate(texts)], 400, 200)


def test_planted_passages_by_what_is_removed(spark, tmp_path):
    """Passages of over 50 words in unlike texts, through the query: n_removed tells those of 400 bytes or more from clean
    texts and from shorter ones; n_bytes is the input's size whatever is planted, and tells nothing."""
    rng = random.Random(21)
    long = [prose(rng, 90, 10**6) + (" née" * 3 if k % 2 else "") for k in range(6)]
    short = [" ".join(f"{rng.randrange(16**4):04x}" for _ in range(60)) for _ in range(3)]
    assert all(len(p.encode()) >= 400 for p in long) and all(50 < len(p.split()) and len(p.encode()) < 390 for p in short)
    planted = {i: long[i % 6] for i in range(30)} | {i: short[i % 3] for i in range(30, 45)}
    texts = {i: f"{i} " + prose(rng, rng.choice([5, 60, 300]), 10**6) + (" été" if i % 3 else "") for i in range(120)}
    texts = {i: f"{t}\n{planted[i]}\n{prose(rng, 20, 10**6)}" if i in planted else t for i, t in texts.items()}
    frame(spark, [(i, t, "en", "s") for i, t in texts.items()]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in sx.op10_suffix_dedup(spark, str(tmp_path)).collect()}
    assert all(rows[i]["n_bytes"] == len(t.encode()) for i, t in texts.items())
    assert all(rows[i]["n_removed"] >= len(planted[i].encode()) and rows[i]["n_spans"] == 1 for i in range(30))
    assert not any(rows[i]["n_removed"] for i in range(30, 120))
    assert [tuple(rows[i])[1:] for i in texts] == plain(texts.values(), 400)


def test_empty(spark):
    assert sx.remove_repeats(frame(spark, corpus()).where("false")).count() == 0


alphabet = st.sampled_from([b"a", b"b", b"ab", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", b""])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(alphabet, max_size=6).map(b"".join), max_size=25))
def test_deep_shallow_sort(strings):
    order, common = sx.deep_shallow_sort(strings)
    assert sorted(order) == list(range(len(strings)))
    assert [strings[i] for i in order] == sorted(strings)
    for a, b, c in zip(order, order[1:], common[1:]):
        s, t = strings[a], strings[b]
        n = next((k for k in range(min(len(s), len(t))) if s[k] != t[k]), min(len(s), len(t)))
        assert c == n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=8), st.text("ab", max_size=8)), min_size=2, max_size=12))
def test_shared_windows(pairs):
    """Regions around a common anchor, against all pairs of windows."""
    anchor, length = b"MIDDLE", 9
    regions = list({(x.encode() + anchor + y.encode(), len(x)) for x, y in pairs})
    regions = [r for r in regions if len(r[0]) >= length]
    got = [set().union(*[range(a, z + 1) for a, z in f]) if f else set() for f in sx.shared_windows(regions, length)]
    for k, (body, at) in enumerate(regions):
        want = set()
        for s in range(max(0, at + len(anchor) - length), min(at, len(body) - length) + 1):
            piece = (s - at, body[s : s + length])
            if any((s2 - a2, b2[s2 : s2 + length]) == piece for m, (b2, a2) in enumerate(regions) if m != k for s2 in range(len(b2) - length + 1)):
                want.add(s)
        # other windows can't come up in use: a region holds those that have its anchor, whole
        assert want == {s for s in got[k] if at + len(anchor) - length <= s <= at}


def test_anchors_depend_on_content_alone(monkeypatch):
    rng = random.Random(3)
    raw = np.frombuffer((prose(rng, 900, 800) + "again " * 80).encode(), np.uint8)
    whole = an.anchors_of(raw, 60, 30)
    assert (np.diff(whole["lo"].astype(int)) == whole["span"][:-1].astype(int) + 1).all()  # every window has one anchor
    shifted = an.anchors_of(np.concatenate([np.frombuffer(b"something before ", np.uint8), raw]), 60, 30)
    inner = set(map(tuple, shifted[["gram", "region"]].tolist()))
    assert sum(tuple(x) in inner for x in whole[["gram", "region"]].tolist()) >= len(whole) - 3
    monkeypatch.setattr(an, "STEP", 100)
    assert (an.anchors_of(raw, 60, 30) == whole).all()


def test_spans_are_united():
    th, lo, end = sx.merge_spans(np.array([2, 1, 1, 1]), np.array([5, 0, 3, 20]), np.array([9, 4, 8, 22]))
    assert list(zip(th, lo, end)) == [(1, 0, 8), (1, 20, 22), (2, 5, 9)]


def test_an_anchor_of_very_many_texts(spark, monkeypatch):
    """A passage in every text, alike around it in some and not in others: dealt by region, nothing else changes."""
    rng = random.Random(9)
    passage, frame_ = "".join(rng.choice("abcdefghij ") for _ in range(300)), "".join(rng.choice("klmnop ") for _ in range(150))
    texts = [(frame_ if i % 3 else f"{i:04d}" * 40) + passage + (frame_ if i % 2 else f"{i * 7:05d}" * 30) for i in range(400)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    monkeypatch.setattr(sx, "HOT_ANCHOR", 20)
    monkeypatch.setattr(sx, "SAMPLE", 1)
    read = frame(spark, rows).selectExpr("doc_id", "xxhash64(text) AS th", "text")
    assert len(sx._frequent_anchors(read, 400, 200))
    check(spark, rows, 400, 200)


def test_records_of_a_batch_are_combined():
    kind = np.dtype([("gram", "<u8"), ("region", "<u8"), ("th", "<i8"), ("lo", "<u4"), ("at", "<u2"), ("span", "<u2"), ("times", "u1")])
    rec = np.zeros(200_002, kind)
    rec["gram"], rec["region"], rec["th"] = 7, 9, np.arange(200_002)
    rec["region"][-2:] = [10, 10]
    rec["th"][-2:] = 5  # one place, told twice
    out = sx.combined(rec)
    sent = out[out["times"] != sx.DONE]
    assert len(out) == 200_002 and sorted(zip(sent["region"].tolist(), sent["times"].tolist())) == [(9, 2), (10, 1)]
