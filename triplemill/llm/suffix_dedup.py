"""Bytes that repeat a string of ``LENGTH`` bytes of an earlier document.

Sorting all suffixes of a corpus is out of reach of the time allowed, and nearly
all of them share nothing. So the work is narrowed down first, without loss:

1. Of every 50 bytes the least 20-byte gram by hash is sampled. Equal strings have
   equal samples, so a string can repeat only where its sample does. Samples are
   packed per bucket of their hash; a bucket's task reads them as a stream and
   passes on the places of those found in two documents.
2. Around such a place lie the strings that hold it, 80 bytes at most: its
   context. A context that another document with a smaller id has whole is removed
   at once.
3. The remaining contexts of a sample are merged: shards of them get a
   Burrows-Wheeler transform, the transforms are merged by interleave refinement,
   and the intervals of suffixes that share 50 bytes tell which strings also start
   in a document with a smaller id (``bwt.py``).
4. The stretches found are joined with the texts.

Samples that are frequent: a task that meets one in several documents passes those
places on itself, by random buckets, and sends a single note to the sample's
bucket. A sample with more than ``HOT`` contexts is split by the bytes around it:
the strings that hold it are halved by where they start, each half has more bytes
in common, and the contexts are dealt out anew by these, at most five times, when
only equal strings are left together.

The id must be a whole number; a row without id comes after all others. A null
text is empty and null ids stay null. Rows with the same id are never earlier than
each other; repeated rows are each in the result; texts under 50 bytes lose
nothing; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplemill.llm.anchors import SIZE, sampled
from triplemill.llm.bwt import least_sharing
from triplemill.llm.common import blocks, mix, word_hashes
from triplemill.plans.scratch import written

LENGTH = 50
REACH = LENGTH - SIZE
# Text per bucket of samples, and samples that a task packs at a time.
BUCKET_BYTES = 12 << 20
FLUSH = 1_000_000
# What is kept of a sample's hash. A bucket has under a million samples, so few
# others look the same, and those are told apart by their contexts.
KEY = np.dtype("<u4")
HOT = 4_096
# Contexts merged at a time, if no sample has more.
MERGE = 1_024
NO_ID = np.iinfo(np.int64).max


def packed(*arrays: np.ndarray) -> bytes:
    small = [a.astype(np.min_scalar_type(int(a.max(initial=0)))) if a.dtype != np.uint8 else a for a in arrays]
    return zstandard.compress(pickle.dumps(small), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    return pickle.loads(zstandard.decompress(data))


# --- 1: samples that two documents have ------------------------------------------


def rows_of_samples(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed samples: (bucket, kind, data). Kind 0 has samples with id and place,
    or a note of a sample known to repeat; kind 1 has places known to repeat."""
    keys, ids, places, count = [], [], [], 0

    def flush():
        k, i, p = np.concatenate(keys), np.concatenate(ids), np.concatenate(places)
        if (i[1:] < i[:-1]).any():
            by_id = np.argsort(i, kind="stable")
            k, i, p = k[by_id], i[by_id], p[by_id]
        hit, note = of_several(k, i)
        out = []
        # Places that repeat, in any bucket; by id, so that they pack well.
        for part in np.array_split(np.flatnonzero(hit), buckets):
            if len(part):
                out.append((int(xxhash.xxh32_intdigest(p[part[:1]].tobytes()) % buckets), 1, deltas(i[part], p[part])))
        noted = np.zeros(len(note), np.int64)
        k, i, p = (np.concatenate([y, x[~hit]]) for x, y in ((k, k[note]), (i, noted - 1), (p, noted)))
        bucket = ((k >> np.uint64(40)) % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
        order = np.argsort(bucket, kind="stable")
        k, i, p, bucket = k[order].astype(KEY), i[order], p[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        for b, (low, high) in enumerate(itertools.pairwise(cuts)):
            if high > low:
                own = k[low:high].view(np.uint8).reshape(-1, KEY.itemsize)
                out.append((b, 0, deltas(i[low:high], p[low:high], own)))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)],
            names=["bucket", "kind", "data"],
        )

    for rows, raw, at in blocks(batches, "text"):
        place, key = sampled(raw, at, LENGTH)
        if len(place):
            doc = np.searchsorted(at, place, side="right") - 1
            # Empty texts share their begin with the next one.
            keys.append(key)
            ids.append(rows.column(0).to_numpy(zero_copy_only=False)[doc])
            places.append(place - at[doc])
            count += len(place)
        if count >= FLUSH:
            yield flush()
            keys, ids, places, count = [], [], [], 0
    if count:
        yield flush()


def of_several(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which samples more than one document has, and one row of each such sample.
    A note has id -1, so it makes any document's sample a repeated one."""
    order = np.argsort(keys)
    k, i = keys[order], ids[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    starts = np.flatnonzero(new)
    least = np.minimum.reduceat(i, starts)
    several = (least != np.maximum.reduceat(i, starts)) | (least == -1)
    hit = np.empty(len(k), bool)
    hit[order] = several[np.cumsum(new) - 1]
    return hit, order[starts[several]]


def deltas(ids: np.ndarray, places: np.ndarray, *others: np.ndarray) -> bytes:
    """Ids in order, as their steps."""
    return packed(ids[:1].view(np.uint64), np.diff(ids).view(np.uint64), places, *others)


def undone(data: bytes) -> tuple[np.ndarray, ...]:
    first, steps, places, *others = unpacked(data)
    ids = np.concatenate([first.astype(np.uint64), steps.astype(np.uint64)]).cumsum(dtype=np.uint64)
    return ids.view(np.int64), places.astype(np.int64), *others


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, place) of samples that two documents have, from packed samples sorted
    by bucket. What is kept is a bucket's samples of one document so far."""

    def out(ids, places):
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(places, pa.int64())], names=["id", "place"]
        )

    held, waiting, now = None, [], None

    def settle():
        """Pass on what repeats; keep the rest, and notes of what repeats."""
        nonlocal held, waiting
        parts = [held, *waiting] if held is not None else waiting
        k, i, p = (np.concatenate(x) for x in zip(*parts, strict=True))
        hit, note = of_several(k, i)
        give = hit & (i != -1)
        held = tuple(
            np.concatenate([x[~hit], y])
            for x, y in ((k, k[note]), (i, np.full(len(note), -1)), (p, np.zeros(len(note), np.int64)))
        )
        waiting = []
        return out(i[give], p[give]) if give.any() else None

    for batch in batches:
        for bucket, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now:
                if waiting and (found := settle()):
                    yield found
                held, waiting, now = None, [], bucket
            if kind == 1:
                yield out(*undone(data))
                continue
            ids, places, own = undone(data)
            waiting.append((own.view(KEY).ravel(), ids, places))
            size = sum(len(w[0]) for w in waiting)
            if size >= max(FLUSH // 2, 0 if held is None else len(held[0])) and (found := settle()):
                yield found
    if waiting and (found := settle()):
        yield found


# --- 2: contexts ------------------------------------------------------------------


class Entries:
    """Contexts as columns: whose they are (id, mark), where they start there, their
    bytes end to end, where the sample lies in them, and from where to where
    strings start, counted from the sample, that are looked at."""

    FIELDS = ("id", "mark", "start", "place", "low", "high", "size")

    def __init__(self, raw: np.ndarray, **columns: np.ndarray):
        self.raw = raw
        for name in self.FIELDS:
            setattr(self, name, columns[name])
        self.at = np.concatenate([[0], np.cumsum(self.size)])

    def __len__(self):
        return len(self.id)

    def pick(self, rows: np.ndarray, **changed: np.ndarray) -> Entries:
        """Some rows; with ``begin``, their contexts cut from there, ``size`` long."""
        begin = changed.pop("begin", np.zeros(len(rows), np.int64))
        columns = {n: changed.get(n, getattr(self, n)[rows]) for n in self.FIELDS}
        return Entries(gathered(self.raw, self.at[rows] + begin, columns["size"]), **columns)

    def shared(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hash of what the strings starting from ``low`` to ``high`` have in
        common, told apart by these; 0 where the context has no such string."""
        first = self.at[:-1] + self.place + high
        end = self.at[:-1] + self.place + low + LENGTH
        some = np.maximum(low, -self.place) <= np.minimum(high, self.size - LENGTH - self.place)
        out = np.zeros(len(self), np.uint64)
        salt = (low[some] * 64 + high[some]).astype(np.uint64)
        out[some] = mix(word_hashes(self.raw, first[some], end[some]) ^ mix(salt)) | np.uint64(1)
        return out

    def codes(self) -> np.ndarray:
        """A number for each different context."""
        arrow = pa.Array.from_buffers(
            pa.large_binary(), len(self), [None, pa.py_buffer(self.at.astype(np.int64)), pa.py_buffer(self.raw)]
        )
        return arrow.dictionary_encode().indices.to_numpy().astype(np.int64)

    def packed(self) -> bytes:
        return packed(
            self.id.view(np.uint64) - self.id.min().view(np.uint64),
            self.id[:0].view(np.uint64) if not len(self) else np.array([self.id.min()]).view(np.uint64),
            self.mark, self.start, self.place, -self.low, -self.high, self.size, self.raw,
        )

    @classmethod
    def unpacked(cls, data: bytes) -> Entries:
        ids, least, mark, start, place, low, high, size, raw = unpacked(data)
        wide = lambda a: a.astype(np.int64)
        return cls(
            raw,
            id=(ids.astype(np.uint64) + least.astype(np.uint64)).view(np.int64),
            mark=wide(mark), start=wide(start), place=wide(place), low=-wide(low), high=-wide(high), size=wide(size),
        )

    @classmethod
    def joined(cls, parts: list[Entries]) -> Entries:
        columns = {n: np.concatenate([getattr(p, n) for p in parts]) for n in cls.FIELDS}
        return cls(np.concatenate([p.raw for p in parts]), **columns)


def gathered(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Pieces of an array, end to end; some at a time, for the places of their
    bytes are many times their size."""
    out = np.empty(int(size.sum()), raw.dtype)
    done = 0
    for low in range(0, len(size), 16_384):
        n = size[low : low + 16_384]
        before = np.cumsum(n) - n
        total = int(n.sum())
        out[done : done + total] = raw[np.arange(total) + np.repeat(first[low : low + 16_384] - before, n)]
        done += total
    return out


def runs(id_, mark, start, stop):
    """Stretches of the same document that touch, made one."""
    if not len(id_):
        return id_, mark, start, stop
    order = np.lexsort([start, mark, id_])
    id_, mark, start, stop = id_[order], mark[order], start[order], stop[order]
    new = np.concatenate([[True], (id_[1:] != id_[:-1]) | (mark[1:] != mark[:-1])])
    # The farthest stop so far within the document: documents are moved apart.
    far = np.cumsum(new) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + far) - far
    new[1:] |= start[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    return id_[begin], mark[begin], start[begin], np.maximum.reduceat(stop, begin)


OUT = "kind int, bucket int, data binary, id bigint, mark bigint, start bigint, stop bigint"
NAMES = [part.split()[0] for part in OUT.split(", ")]
TYPES = [pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 4]


def given(stretches: tuple) -> pa.RecordBatch:
    """Rows of kind 1: bytes to be removed."""
    n = len(stretches[0])
    columns = [np.ones(n, np.int32), np.zeros(n, np.int32), [b""] * n, *stretches]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=NAMES
    )


def dealt(entries: Entries, buckets: int) -> pa.RecordBatch:
    """Rows of kind 0: contexts by bucket of what their strings have in common."""
    bucket = ((entries.shared(entries.low, entries.high) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort([entries.start, entries.mark, entries.id, bucket])
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    data = {
        b: entries.pick(order[low:high]).packed() for b, (low, high) in enumerate(itertools.pairwise(cuts)) if high > low
    }
    n = len(data)
    columns = [np.zeros(n, np.int32), list(data), list(data.values()), *[np.zeros(n, np.int64)] * 4]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], names=NAMES
    )


def least_ids(group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the least id of its group."""
    out = np.full(int(group.max(initial=-1)) + 1, NO_ID)
    np.minimum.at(out, group, ids)
    return out[group]


def pairs_numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each different pair, in the order of the pairs."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def contexts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Contexts of the places of each document (id, mark, text, places). Those
    that a smaller id has whole, among the rows met together, are given as
    stretches at once."""
    parts: list[Entries] = []

    def flush():
        entries = Entries.joined(parts)
        parts.clear()
        later = entries.id > least_ids(entries.codes(), entries.id)
        first = entries.pick(np.flatnonzero(~later))
        found = runs(*(x[later] for x in (entries.id, entries.mark, entries.start, entries.start + entries.size)))
        return given(found), dealt(first, buckets)

    for rows, raw, at in blocks(batches, "text"):
        places = rows.column(3)
        doc = np.repeat(np.arange(rows.num_rows), pc.list_value_length(places).to_numpy())
        place = pc.list_flatten(places).to_numpy()
        wide = int(place.max(initial=0)) + 1
        doc, place = np.divmod(np.unique(doc * wide + place), wide)
        size = np.diff(at)[doc]
        start, stop = np.maximum(place - REACH, 0), np.minimum(place + LENGTH, size)
        # A place comes from the id; another text of that id may be too short.
        good = (stop - start >= LENGTH) & (place + SIZE <= size)
        doc, place, start, stop = doc[good], place[good], start[good], stop[good]
        if not len(doc):
            continue
        parts.append(
            Entries(
                gathered(raw, at[doc] + start, stop - start),
                id=rows.column(0).to_numpy()[doc],
                mark=rows.column(1).to_numpy()[doc],
                start=start,
                place=place - start,
                low=np.full(len(doc), -REACH),
                high=np.zeros(len(doc), np.int64),
                size=stop - start,
            )
        )
        if sum(map(len, parts)) >= FLUSH // 16:
            yield from flush()
    if parts:
        yield from flush()


# --- 3: merging ---------------------------------------------------------------------


def halves(entries: Entries) -> list[Entries]:
    """Entries of frequent samples, each as two with half the strings."""
    out = []
    middle = (entries.low + entries.high) // 2
    for low, high in ((entries.low, middle), (middle + 1, entries.high)):
        begin = np.maximum(entries.place + low, 0)
        end = np.minimum(entries.place + high + LENGTH, entries.size)
        some = np.flatnonzero(end - begin >= LENGTH)
        out.append(
            entries.pick(
                some, begin=begin[some], size=(end - begin)[some], start=(entries.start + begin)[some],
                place=(entries.place - begin)[some], low=low[some], high=high[some],
            )
        )
    return out


def may_share(entries: Entries, sample: np.ndarray, group: np.ndarray) -> Entries:
    """Entries of whose strings one can be in another group of the sample, cut to
    these: strings that start in the same eighth share at least 46 bytes. With
    ``row``, where they are in the entries."""
    low_of, high_of = entries.high + 1, entries.low - 1
    wide = entries.high - entries.low + 1
    for part in range(8):
        low = entries.low + wide * part // 8
        high = entries.low + wide * (part + 1) // 8 - 1
        key = np.where(high >= low, entries.shared(low, np.maximum(low, high)), np.uint64(0))
        some = np.flatnonzero(key)
        if not len(some):
            continue
        key = mix(key[some]) ^ sample[some]
        order = np.lexsort([group[some], key])
        k, g = key[order], group[some][order]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        ends = np.append(start[1:], len(k))
        hit = some[order[np.repeat(g[start] != g[ends - 1], ends - start)]]
        low_of[hit] = np.minimum(low_of[hit], low[hit])
        high_of[hit] = np.maximum(high_of[hit], high[hit])
    row = np.flatnonzero(high_of >= low_of)
    low, high = low_of[row], high_of[row]
    begin = np.maximum(entries.place[row] + low, 0)
    size = np.minimum(entries.place[row] + high + LENGTH, entries.size[row]) - begin
    cut = entries.pick(row, begin=begin, size=size, start=entries.start[row] + begin, place=entries.place[row] - begin, low=low, high=high)
    cut.row = row
    return cut


def merge_group(entries: Entries, group: np.ndarray, sample: np.ndarray) -> tuple:
    """Stretches of entries (all the first of their group) that hold a string
    which an entry with a smaller id has as well."""
    entries = may_share(entries, sample, group)
    group, sample = group[entries.row], sample[entries.row]
    found = []
    order = np.lexsort([group, sample])
    while len(order):
        # Whole samples, about MERGE entries.
        n = int(np.searchsorted(sample[order], sample[order[min(MERGE, len(order)) - 1]], side="right"))
        now, order = order[:n], order[n:]
        one = now[np.concatenate([[True], group[now][1:] != group[now][:-1]])]
        texts = [entries.raw[entries.at[r] : entries.at[r + 1]].tobytes() for r in one.tolist()]
        text, offset, least = least_sharing(texts, entries.id[one], LENGTH)
        hit = least < entries.id[one][text]
        text, offset = text[hit], offset[hit]
        text, _, start, stop = runs(text, np.zeros_like(text), offset, offset + LENGTH)
        # Each run for all entries of its group.
        first = np.cumsum(np.concatenate([[True], group[now][1:] != group[now][:-1]])) - 1
        low = np.searchsorted(text, first, side="left")
        n_runs = np.searchsorted(text, first, side="right") - low
        row = np.repeat(now, n_runs)
        run = np.arange(len(row)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs) + np.repeat(low, n_runs)
        found.append((entries.id[row], entries.mark[row], entries.start[row] + start[run], entries.start[row] + stop[run]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def merged_buckets(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """From packed contexts sorted by bucket: stretches to be removed, and for a
    next round the halves of frequent samples. What is kept is the first entry of
    each context of a bucket, but none of a frequent sample."""
    parts: list[Entries] = []
    frequent = np.zeros(0, np.uint64)
    now, limit = None, 0

    def settle(last: bool):
        nonlocal parts, frequent, limit
        entries = Entries.joined(parts)
        sample = entries.shared(entries.low, entries.high)
        group = pairs_numbered(np.unique(sample, return_inverse=True)[1], entries.codes())
        later = entries.id > least_ids(group, entries.id)
        yield given(runs(*(x[later] for x in (entries.id, entries.mark, entries.start, entries.start + entries.size))))
        keep = np.flatnonzero(~later)
        _, one = np.unique(group[keep], return_index=True)
        names, count = np.unique(sample[keep[one]], return_counts=True)
        frequent = np.union1d(frequent, names[count > HOT])
        split = np.isin(sample[keep], frequent) & (entries.low < entries.high)[keep]
        for half in halves(entries.pick(keep[split])):
            if len(half):
                yield dealt(half, buckets)
        keep = keep[~split]
        rest = entries.pick(keep)
        if last:
            if len(rest):
                yield given(runs(*merge_group(rest, group[keep], sample[keep])))
            parts, frequent = [], frequent[:0]
        else:
            parts, limit = [rest], 2 * len(rest)

    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != now:
                if parts:
                    yield from settle(True)
                now, limit = bucket, 0
            parts.append(Entries.unpacked(data))
            if sum(map(len, parts)) >= max(FLUSH // 16, limit):
                yield from settle(False)
    if parts:
        yield from settle(True)


def pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, data) with the text compressed, for the way through a shuffle."""
    for rows, raw, at in blocks(batches, "text"):
        data = [zstandard.compress(raw[a:b].tobytes(), 3) for a, b in itertools.pairwise(at)]
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(1), pa.array(data, pa.binary())], names=["id", "mark", "data"]
        )


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The third column as text again, a few rows at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            some = batch.slice(low, 256)
            texts = [zstandard.decompress(d.as_py()) for d in some.column(2)]
            columns = [*some.columns[:2], pa.array(texts, pa.large_binary()), *some.columns[3:]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "text", *some.schema.names[3:]])


def stretches(docs: DataFrame) -> DataFrame:
    """``id, mark, spans`` of the bytes to be removed, from ``id, mark, text``."""
    text_size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = text_size // BUCKET_BYTES + 1
    samples = docs.select("id", "text").mapInArrow(
        lambda batches: rows_of_samples(batches, buckets), "bucket int, kind int, data binary"
    )
    places = (
        samples.repartition(buckets, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(repeated, "id bigint, place bigint")
        .groupBy("id")
        .agg(F.collect_list("place").alias("places"))
    )
    now = (
        docs.mapInArrow(pressed, "id bigint, mark bigint, data binary")
        .join(places, "id")
        .select("id", "mark", "data", "places")
        .mapInArrow(lambda batches: contexts(opened(batches), buckets), OUT)
    )
    # Stretches met on the way pass through the shuffle to any bucket.
    given_rows = []
    while True:
        now = written(
            now.repartition(buckets, F.when(F.col("kind") == 0, F.col("bucket")).otherwise(F.col("id") % buckets))
            .sortWithinPartitions("kind", "bucket")
            .mapInArrow(lambda batches: one_round(batches, buckets), OUT)
        )
        given_rows.append(now.where("kind = 1"))
        now = now.where("kind = 0")
        if now.isEmpty():
            break
    every = given_rows[0]
    for more in given_rows[1:]:
        every = every.unionByName(more)
    return every.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def one_round(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Pass on the stretches, which come last, and merge the contexts."""
    over: list[pa.RecordBatch] = []

    def open_ones():
        for batch in batches:
            n = int(np.count_nonzero(batch.column(0).to_numpy() == 0))
            if n < batch.num_rows:
                over.append(batch.slice(n))
            if n:
                yield batch.select(["bucket", "data"]).slice(0, n)
            if n < batch.num_rows:
                return

    yield from merged_buckets(open_ones(), buckets)
    yield from over
    yield from batches


# --- 4: texts ------------------------------------------------------------------------


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the spans, and the number of runs removed."""
    kept, at, runs = [], 0, 0
    end = -1
    for start, stop in sorted(spans):
        if start > end:
            runs += 1
            kept.append(text[at:start])
        end = max(end, stop)
        at = max(at, end)
    kept.append(text[at:])
    return b"".join(kept), runs


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_bytes, n_removed, n_spans, kept (bytes)."""
    rows = docs.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit(2**32 - 1)).alias("mark"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    spans = stretches(rows)
    kind = docs.schema[key].dataType.simpleString()

    def finish(batches):
        for batch in opened(batches):
            ids, _, texts, own = batch.columns
            texts = texts.to_pylist()
            done = [
                cut(t, [(s["start"], s["stop"]) for s in w.as_py() or ()])
                for t, w in zip(texts, own, strict=True)
            ]
            size = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(size, pa.int64()),
                    pa.array([n - len(k) for n, (k, _) in zip(size, done, strict=True)], pa.int64()),
                    pa.array([n for _, n in done], pa.int64()),
                    pa.array([k for k, _ in done], pa.binary()),
                ],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    done = (
        rows.mapInArrow(pressed, "id bigint, mark bigint, data binary")
        .join(spans, ["id", "mark"], "left")
        .select("id", "mark", "data", "spans")
        .mapInArrow(finish, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    )
    return done.select(
        F.when(F.col("id") != NO_ID, F.col("id")).cast(kind).alias(key),
        "n_bytes",
        "n_removed",
        "n_spans",
        "kept",
    )


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``removed`` with the SHA-256 of what is kept in place of it."""
    return removed(docs, key, text).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
