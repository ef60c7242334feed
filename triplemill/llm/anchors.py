"""Sampled positions of texts such that equal stretches have equal samples."""

from __future__ import annotations

import numpy as np

from triplemill.llm.common import mix

SIZE = 20


def grams(raw: np.ndarray, size: int = SIZE) -> np.ndarray:
    """64-bit hash of the ``size`` bytes from each position on, doubling the
    length step by step. Shorter by ``size - 1`` than ``raw``."""
    base = 0x9E3779B97F4A7C15
    if len(raw) < size:
        return np.zeros(0, np.uint64)
    single = raw.astype(np.uint64) + np.uint64(1)
    power, width, out, done = single, 1, None, 0
    while True:
        if size & width:
            if out is None:
                out, done = power, width
            else:
                n = len(raw) - done - width + 1
                out = out[:n] * np.uint64(pow(base, width, 2**64)) + power[done : done + n]
                done += width
        if done == size:
            return mix(out)
        n = len(power) - width
        power = power[:n] * np.uint64(pow(base, width, 2**64)) + power[width : width + n]
        width *= 2


def sampled(raw: np.ndarray, at: np.ndarray, window: int, size: int = SIZE):
    """Positions (in ``raw``) and hashes of the grams that are the least, leftmost,
    of some ``window`` bytes inside one text: every window holds one, and equal
    windows hold the same one at the same place."""
    h = grams(raw, size)
    span = window - size + 1
    n = len(raw) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # Hash and place in one number: the least is the least hash, leftmost. Least
    # of 2^k neighbours, then of two overlapping ones.
    low32 = np.uint64(2**32 - 1)
    least, width = (h & ~low32) | np.arange(len(h), dtype=np.uint64), 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    place = np.minimum(least[:n], least[span - width : span - width + n]) & low32
    # Windows that run into the next text do not count.
    inside = np.ones(n, bool)
    for end in at[1:-1]:
        inside[max(0, end - window + 1) : min(end, n)] = False
    place = place[inside]
    if not len(place):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.concatenate([[True], place[1:] != place[:-1]])
    place = place[first].astype(np.int64)
    return place, h[place]
