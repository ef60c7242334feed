"""Documents that hold passages of a benchmark, found by spaced seeds.

A seed is some words picked by a fixed mask out of up to ten. For items of 13 words
and more the four masks of six words together see any 13 words in which two are
replaced, wherever they stand; for items of 10 to 12 words six masks of five words
see any ten with two replaced; shorter items have to stand whole, and their seed is
all their words. Seeds of all documents are joined with the seeds of the benchmark
by their hashes. Around each hit the words are laid side by side, without shift,
over the whole item, and the document is reported if some ``WINDOW`` words agree in
at least ``AGREE`` of 100 (over the whole item where that is shorter). So a passage
of 13 words or a whole shorter item is found exactly if two words at most differ;
passages that differ more are found where a seed is left.

Hits are shifts of an item against a document. Neighbouring words with the same
seed, as in texts that repeat a word, are one run, and two runs give their shifts
at once; shifts are collected a bounded number of hits at a time and laid side by
side until one agrees in full.

The benchmark is taken in parts of a bounded number of bytes, each of which is
sent to all tasks and met with all documents, and released before the next; there
is one part unless the benchmark is large. No document is shuffled.

Words are lower-cased (A-Z). An item of fewer than ``LEAST`` words cannot be told
from chance and is not searched for. Null and empty texts hold nothing; repeated
rows are reported each, also without id; without documents or items the result is
empty. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplemill.llm.common import LOWER, blocks, mix, word_hashes, word_spans
from triplemill.plans.scratch import written

# Picked positions out of ten.
MASKS = (
    (0, 1, 2, 4, 5, 6),
    (0, 3, 4, 6, 8, 9),
    (0, 1, 2, 5, 8, 9),
    (0, 2, 6, 7, 8, 9),
)
# Every two positions are both left out by some mask.
SHORT_MASKS = (
    (0, 1, 2, 4, 9),
    (1, 3, 6, 7, 8),
    (4, 5, 6, 7, 9),
    (0, 1, 2, 3, 5),
    (0, 2, 6, 7, 8),
    (3, 4, 5, 8, 9),
)
SPAN = 10
LEAST = 5
WINDOW = 13
AGREE = 80
PART_BYTES = 2 << 20
# Hits that are held at a time.
HITS = 1 << 21

# Least and most words of the items, words that a mask reaches over, masks.
FAMILIES = (
    *((n, n, n, (tuple(range(n)),)) for n in range(LEAST, SPAN)),
    (SPAN, WINDOW - 1, SPAN, SHORT_MASKS),
    (WINDOW, 2**62, SPAN, MASKS),
)


def hashed(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin."""
    low = LOWER[raw]
    first, end = word_spans(low, at)
    return word_hashes(low, first, end), np.searchsorted(first, at)


def seeds(words: np.ndarray, span: int, masks) -> list[np.ndarray]:
    """Per mask the hash of the picked words from each position on."""
    n = max(0, len(words) - span + 1)
    picked = [words * np.uint64(2 * 0x9E3779B97F4A7C15 * (j + 1) % 2**64 | 1) for j in range(max(map(len, masks)))]
    out = []
    for number, mask in enumerate(masks):
        total = np.full(n, number, np.uint64)
        for j, offset in enumerate(mask):
            total += picked[j][offset : offset + n]
        out.append(mix(total))
    return out


def in_runs(keys: np.ndarray, places: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbouring places of one owner with one key as key, first place, length."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (places[1:] != places[:-1] + 1) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return keys[first], places[first], np.diff(np.append(first, len(keys)))


class Family:
    """Seeds of the items of one length, sorted, in runs."""

    def __init__(self, words: np.ndarray, begin: np.ndarray, least: int, most: int, span: int, masks):
        self.span, self.masks, self.runs, self.seen = span, masks, [], []
        size = np.diff(begin)
        position = np.arange(max(0, len(words) - span + 1))
        item = np.searchsorted(begin, position, side="right") - 1
        own = (position + span <= begin[item + 1]) & (size[item] >= least) & (size[item] <= most)
        self.some = bool(own.any())
        for keys in seeds(words, span, masks) if self.some else ():
            keys, places, items = keys[own], position[own], item[own]
            order = np.argsort(keys, kind="stable")
            self.runs.append(in_runs(keys[order], places[order], items[order]))
            # Which leading bits occur: most seeds of documents end here.
            bits = int(max(8 * len(keys), 256)).bit_length()
            seen = np.zeros(1 << bits, bool)
            seen[keys >> np.uint64(64 - bits)] = True
            self.seen.append((np.uint64(64 - bits), seen))

    def hits(self, words: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Runs of positions in the words and in the items' words with equal
        seeds: first place and length of either, ``HITS`` shifts or so at a time."""
        for keys, (known, first, length), (shift, seen) in zip(
            seeds(words, self.span, self.masks), self.runs, self.seen, strict=True
        ):
            some = np.flatnonzero(seen[keys >> shift])
            doc = np.searchsorted(begin, some, side="right") - 1
            key, place, size = in_runs(keys[some], some, doc)
            low = np.searchsorted(known, key, side="left")
            n = np.searchsorted(known, key, side="right") - low
            met = n > 0
            place, size, low, n = place[met], size[met], low[met], n[met]
            while len(n):
                take = max(1, int(np.searchsorted(np.cumsum(n), HITS, side="right")))
                k = n[:take]
                row = np.repeat(np.arange(take)[: len(k)], k)
                other = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low[:take], k)
                yield place[row], size[row], first[other], length[other]
                place, size, low, n = place[take:], size[take:], low[take:], n[take:]


class Part:
    """Some items, and their seeds."""

    def __init__(self, ids: list, texts: list[bytes]):
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        self.ids = ids
        self.words, self.begin = hashed(raw, at)
        families = [Family(self.words, self.begin, *f) for f in FAMILIES]
        self.families = [f for f in families if f.some]

    def shifts(self, words: np.ndarray, begin: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Per document and item the places in the document's words at which the
        item's first word may lie."""
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for family in self.families:
            for place, size, other, length in family.hits(words, begin):
                doc = np.searchsorted(begin, place, side="right") - 1
                item = np.searchsorted(self.begin, other, side="right") - 1
                shift = (place - begin[doc]) - (other - self.begin[item])
                # Two runs meet at a range of shifts.
                low, high = shift - (length - 1), shift + size
                order = np.lexsort([low, item, doc])
                doc, item, low, high = doc[order], item[order], low[order], high[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
                cuts = np.append(np.flatnonzero(new), len(doc))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    found.setdefault((int(doc[a]), int(item[a])), []).append(covered(low[a:b], high[a:b]))
        return {pair: np.unique(np.concatenate(some)) for pair, some in sorted(found.items())}

    def overlap(self, item: int, words: np.ndarray, shift: int) -> tuple[int, int, int] | None:
        """Agreeing words, begin and end (in the document's words) of what
        agrees when the item's first word is laid at ``shift``."""
        own = self.words[self.begin[item] : self.begin[item + 1]]
        low, high = max(0, shift), min(len(words), shift + len(own))
        equal = words[low:high] == own[low - shift : high - shift]
        wide = min(WINDOW, len(own))
        if high - low < wide:
            return None
        sums = np.concatenate([[0], np.cumsum(equal)])
        good = np.flatnonzero((sums[wide:] - sums[:-wide]) * 100 >= AGREE * wide)
        if not len(good):
            return None
        covered = np.zeros(len(equal) + 1, np.int64)
        np.add.at(covered, good, 1)
        np.add.at(covered, good + wide, -1)
        inside = (np.cumsum(covered)[:-1] > 0) & equal
        at = np.flatnonzero(inside)
        return len(at), int(low + at[0]), int(low + at[-1] + 1)


def covered(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers in some of the ranges, which are sorted by ``low``."""
    far = np.maximum.accumulate(high)
    begin = low.copy()
    begin[1:] = np.maximum(low[1:], far[:-1])
    n = np.maximum(high - begin, 0)
    return np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)


def parts_of(benchmark: DataFrame, item: str, text: str) -> Iterator[Part]:
    """The benchmark in parts of about PART_BYTES, one item at least."""
    rows = benchmark.select(F.col(item).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = F.octet_length("text")
    whole = rows.agg(F.sum(size)).first()[0] or 0
    n = -(-whole // PART_BYTES)
    while n:
        part = F.pmod(F.xxhash64("text"), F.lit(n))
        sizes = rows.groupBy(part.alias("p")).agg(F.sum(size).alias("s"), F.countDistinct("text").alias("k"))
        if sizes.where((F.col("s") > 2 * PART_BYTES) & (F.col("k") > 1)).isEmpty():
            break
        n *= 2
    for p in range(n):
        found = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == p).orderBy("item", "text").collect()
        if found:
            yield Part([r["item"] for r in found], [r["text"].encode() for r in found])


def matches_in(docs: DataFrame, shared, kinds: tuple[str, str]) -> DataFrame:
    def search(batches):
        part = shared.value
        for rows, raw, at in blocks(batches, "text"):
            words, begin = hashed(raw, at)
            found: dict[tuple[int, int], tuple] = {}
            for (d, i), places in part.shifts(words, begin).items():
                own, best = words[begin[d] : begin[d + 1]], None
                for place in places.tolist():
                    met = part.overlap(i, own, place)
                    if met and (best is None or met[0] > best[0]):
                        best = met
                        if met[0] == part.begin[i + 1] - part.begin[i]:
                            break
                if best:
                    found[d, i] = best
            if found:
                keys = rows.column(0).take(pa.array([d for d, _ in found]))
                ids = pa.array([part.ids[i] for _, i in found])
                numbers = [pa.array(x, pa.int64()) for x in zip(*found.values(), strict=True)]
                sizes = [int(part.begin[i + 1] - part.begin[i]) for _, i in found]
                yield pa.RecordBatch.from_arrays(
                    [keys, ids, *numbers, pa.array(sizes, pa.int64())],
                    names=["key", "item", "agreeing", "first", "last", "size"],
                )

    schema = f"key {kinds[0]}, item {kinds[1]}, agreeing bigint, first bigint, last bigint, size bigint"
    return docs.mapInArrow(search, schema)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document and item it holds: key, item, n_agreeing words,
    first_word and last_word (exclusive) in the document, n_item_words."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kinds = (
        rows.schema[0].dataType.simpleString(),
        benchmark.select(item).schema[0].dataType.simpleString(),
    )
    schema = f"key {kinds[0]}, item {kinds[1]}, agreeing bigint, first bigint, last bigint, size bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    last = None
    for part in parts_of(benchmark, item, item_text):
        if last is not None:
            out = out.unionByName(written(matches_in(rows, last, kinds)))
            last.destroy()
        last = docs.sparkSession.sparkContext.broadcast(part)
    if last is not None:
        out = out.unionByName(matches_in(rows, last, kinds))
    return out.select(
        F.col("key").alias(key),
        F.col("item").alias(item),
        F.col("agreeing").alias("n_agreeing"),
        F.col("first").alias("first_word"),
        F.col("last").alias("last_word"),
        F.col("size").alias("n_item_words"),
    )
