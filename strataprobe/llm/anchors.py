"""Content anchors: the places of a text where equal long strings are sure to meet.

Every window of `length` bytes has one anchor: the start of the `gram`-byte string of least hash in it
(the leftmost of equals). Equal windows have their anchor at the same offset, so windows need only be
compared where their anchors' strings agree.
"""

from __future__ import annotations

import numpy as np

from .jaccard import BYTE_CODE, LANES, U, mix64, powers

PLAIN_CODE = BYTE_CODE.copy()
PLAIN_CODE[65:91] = mix64(np.arange(65, 91, dtype=U) + LANES[1])
POS_BITS = 22
ANCHOR = np.dtype([("gram", "<u8"), ("region", "<u8"), ("lo", "<u4"), ("at", "<u2"), ("span", "<u2")])
STEP = 1 << 19


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] for every i that has one."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def anchors_of(raw: np.ndarray, length: int, gram: int) -> np.ndarray:
    """ANCHOR records of a text's bytes, in order. gram: hash of the anchor's string; region: hash of
    the bytes of all windows that have it; lo: start of the first of these windows; at: the anchor
    from lo; span: start of the last of these windows from lo."""
    n = len(raw)
    if n < length:
        return np.zeros(0, ANCHOR)
    out = []
    for begin in range(0, n - length + 1, STEP):
        # windows that start in [begin, begin + STEP); a run of windows cut here is joined below
        out.append(_anchors(raw[begin : begin + STEP + length - 1], length, gram, begin))
    if len(out) == 1:
        return out[0]
    rec = np.concatenate(out)
    where = rec["lo"].astype(np.int64) + rec["at"]
    new = np.r_[True, where[1:] != where[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(rec)] - 1
    joined = rec[first]
    for i in np.flatnonzero(last > first):
        a, z = rec[first[i]], rec[last[i]]
        hi = int(z["lo"]) + int(z["span"])
        joined[i]["span"] = hi - int(a["lo"])
        joined[i]["region"] = _region(raw[int(a["lo"]) : hi + length], int(a["at"]))
    return joined


def _region(b: np.ndarray, at: int) -> np.uint64:
    up, _ = powers(len(b))
    h = np.array([(PLAIN_CODE[b] * up[: len(b)]).sum()], U)
    return mix64(h + LANES[:1] * U(at) + LANES[2:3] * U(len(b)))[0]


def _anchors(b: np.ndarray, length: int, gram: int, begin: int) -> np.ndarray:
    n = len(b)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(PLAIN_CODE[b] * up[:n], out=sums[1:])
    grams = mix64((sums[gram:] - sums[: n - gram + 1]) * down[: n - gram + 1])
    key = (grams & ~U((1 << POS_BITS) - 1)) | np.arange(len(grams), dtype=U)
    least = (sliding_min(key, length - gram + 1) & U((1 << POS_BITS) - 1)).astype(np.int64)
    lo = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    hi = np.r_[lo[1:], len(least)] - 1
    at = least[lo]
    end = hi + length
    region = (sums[end] - sums[lo]) * down[lo]
    rec = np.zeros(len(lo), ANCHOR)
    rec["gram"] = grams[at]
    rec["region"] = mix64(region + LANES[0] * (at - lo).astype(U) + LANES[2] * (end - lo).astype(U))
    rec["lo"], rec["at"], rec["span"] = lo + begin, at - lo, hi - lo
    return rec
