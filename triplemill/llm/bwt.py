"""Burrows-Wheeler transforms of small shards of texts, and their merge.

A shard is transformed by sorting its own suffixes. Shards are then merged by
refining their interleave: round k sorts all suffixes by their first k characters,
by one stable counting sort of the transforms' characters as the interleave of
round k - 1 shows them; no suffix is looked at, let alone sorted again. Where a
boundary between two neighbours appears in round k, their common prefix is k - 1
long, so after k rounds the stretches without a boundary are the suffixes that
share k characters.
"""

from __future__ import annotations

import numpy as np


class Shard:
    """Transform of sorted texts: per rank the character before the suffix (0 at
    a text's begin), the rank of the suffix one character longer (at a text's
    begin that of the empty one: texts are cyclic), and the suffix's text and
    offset."""

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts], np.int64)
        begin = np.concatenate([[0], np.cumsum(size + 1)])
        total = int(begin[-1])
        raw = np.zeros(total, np.uint8)
        letters = np.frombuffer(b"".join(texts), np.uint8)
        self.text = np.repeat(np.arange(len(texts)), size + 1)
        self.offset = np.arange(total) - begin[self.text]
        # UTF-8 has no byte 255, so one more still fits, and 0 ends a text.
        raw[self.offset < size[self.text]] = letters + np.uint8(1)
        wide = int(size.max(initial=0)) + 1
        left = size[self.text] - self.offset
        padded = np.concatenate([raw, np.zeros(wide, np.uint8)])
        rows = np.lib.stride_tricks.sliding_window_view(padded, wide)[:total].copy()
        rows[np.arange(wide)[None, :] >= left[:, None]] = 0
        order = np.argsort(rows.view(f"S{wide}").ravel(), kind="stable")
        rank = np.empty(total, np.int64)
        rank[order] = np.arange(total)
        before = np.where(self.offset > 0, np.arange(total) - 1, begin[self.text + 1] - 1)
        self.last = np.where(self.offset > 0, raw[np.maximum(before, 0)], 0)[order].astype(np.uint8)
        self.longer = rank[before][order]
        self.text, self.offset = self.text[order], self.offset[order]


def joined(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """Characters and longer suffixes of shards put end to end."""
    base = np.cumsum([0, *(len(s.last) for s in shards)])
    last = np.concatenate([s.last for s in shards])
    longer = np.concatenate([s.longer + b for s, b in zip(shards, base, strict=False)])
    return last, longer.astype(np.int32)


def refined(now, block, last, longer):
    """One round: the suffixes one character longer, in order, their blocks, and
    where a block begins."""
    letter = last[now]
    order = np.argsort(letter, kind="stable")
    now, block, letter = longer[now[order]], block[order], letter[order]
    begins = np.ones(len(now), bool)
    begins[1:] = (letter[1:] != letter[:-1]) | (block[1:] != block[:-1])
    return now, np.cumsum(begins, dtype=np.int32), begins


def merged(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave by the first ``depth`` characters, as ranks in the shards put
    end to end, and the common prefix of each suffix with the one before, up to
    ``depth`` (-1 for the first)."""
    last, longer = joined(shards)
    now, block = np.arange(len(last), dtype=np.int32), np.zeros(len(last), np.int32)
    common = np.full(len(last), depth, np.int16)
    for k in range(1, depth + 1):
        now, block, begins = refined(now, block, last, longer)
        common[begins & (common == depth)] = k - 1
    common[:1] = -1
    return now, common


def shared(shards: list[Shard], depth: int, start: np.ndarray):
    """The same for the suffixes that grow out of the ranks ``start`` by ``depth``
    characters only: their interleave, where an interval begins, and, as (ranks
    after k rounds, k), those taken out on the way. A suffix that shares its first k
    characters with no other is alone, and so is what grows out of it."""
    last, longer = joined(shards)
    now, block = start.astype(np.int32), np.zeros(len(start), np.int32)
    begins, alone = np.ones(len(start), bool), []
    for k in range(1, depth + 1):
        now, block, begins = refined(now, block, last, longer)
        if k % STEP == 0 and k < depth:
            single = begins & np.append(begins[1:], True)
            if single.any():
                alone.append((now[single], k))
                now, block = now[~single], block[~single]
    return now, begins, alone


# Rounds after which suffixes that are alone are taken out.
STEP = 4


def least_sharing(texts: list[bytes], values: np.ndarray, depth: int, shard: int = 128):
    """For each text and offset with ``depth`` bytes from there on: the least
    value of all texts that have the same ``depth`` bytes anywhere. Returned as
    three arrays: text, offset, least."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    shards, owner, offset = [], [], []
    for low in range(0, len(order), shard):
        own = np.array(order[low : low + shard])
        made = Shard([texts[i] for i in own])
        shards.append(made)
        owner.append(own[made.text])
        offset.append(made.offset)
    owner, offset = np.concatenate(owner), np.concatenate(offset)
    # A string of ``depth`` bytes grows, byte by byte, out of the suffix behind it.
    now, begins, alone = shared(shards, depth, np.flatnonzero(offset >= depth))
    found = [(owner[ranks], offset[ranks] - (depth - k), values[owner[ranks]]) for ranks, k in alone]
    if len(now):
        least = np.minimum.reduceat(values[owner[now]], np.flatnonzero(begins))
        found.append((owner[now], offset[now], least[np.cumsum(begins) - 1]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
