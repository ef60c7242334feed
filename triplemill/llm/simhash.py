"""SimHash near-duplicates by anchor points of a covering code.

The anchors are code words of the binary Golay code, which is perfect: every 23
bits have one code word within 3 bits, their home. If two blocks of 23 bits
differ in at most t bits, and one's home is at a distance of at most 3 from it,
that home is within 3 + t of the other. So each fingerprint is put once at its
home, and as a visitor at every code word within 3 + t, and only homes and
visitors of the same anchor are compared.

``near_fingerprints`` (64 bits, threshold 2) uses an anchor of two code words, 46
of the 64 bits; the excess over 3 of both blocks together is at most 2. It finds
every pair. A fingerprint has 61 places on the average, and 2^24 anchors share
all homes, so a comparison partner is rare unless it is close.

``near_texts`` (256 bits, Jaccard similarity of 0.8 and more of 5-word shingles)
needs many differing bits, about 15 in 100, so no single anchor would do: each of
11 blocks of 23 bits gives a place of its own, with an excess of 1, and a pair
is missed only if it is farther apart in all blocks. These links only gather
texts; within what they gather, the sets of shingles themselves are compared, and
only texts with a similarity of 0.8 and more are linked. A gathering of more than
``TEXTS`` texts or ``BYTES`` bytes is dealt into blocks, and each two blocks are
compared in one task. Components are made of those links, so two texts of one
component are linked by steps of 0.8, not always directly.

Equal fingerprints (equal sets of shingles in ``near_texts``) are one row before
anything is compared, so copies cost nothing. Links of an anchor are handed on as
a spanning forest, not as pairs.

A null text is empty; a text without words has fingerprint zero, which is linked
like any other; a text with fewer words than a shingle is one shingle; repeated
rows are each in the result; a null id is never a component's least id unless no
row of it has another; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplemill.llm.common import blocks, look_up, mix
from triplemill.llm.components import components
from triplemill.plans.scratch import written

SEED = 42
BITS = 23
RADIUS = 3
# Fixed value: x^11+x^10+x^6+x^5+x^4+x^2+1, generator of the Golay code.
GENERATOR = 0b110001110101


# --- fingerprints --------------------------------------------------------------


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, lower-cased; all words if fewer."""
    words = text.lower().split()  # bytes: A-Z, and the six blanks of ASCII, only
    if len(words) < size:
        runs = [b" ".join(words)] if words else []
    else:
        runs = map(b" ".join, zip(*(itertools.islice(words, i, None) for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(r, SEED) for r in runs], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in more than half of the hashes."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.zeros(64, np.int64)
    for low in range(0, len(bits), 255):
        counts += np.add.reduce(bits[low : low + 255], axis=0, dtype=np.uint8)
    kept = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(kept.view(np.uint64)[0])


def fingerprint(text: bytes, size: int, lanes: int) -> list[int]:
    """``lanes`` numbers of 64 bits; the first is that of the hashes themselves,
    the others are of the hashes mixed anew."""
    return lanes_from(shingle_hashes(text, size), lanes)


def lanes_from(hashes: np.ndarray, lanes: int) -> list[int]:
    out = [majority(hashes)]
    for lane in range(1, lanes):
        out.append(majority(mix(hashes ^ np.uint64(0xD6E8FEB86659FD93 * lane % 2**64))))
    return out


def fingerprints(docs: DataFrame, key: str, text: str, size: int, lanes: int = 1) -> DataFrame:
    """``key, f`` with the fingerprint as 16 hex digits a lane."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in blocks(batches, "text"):
            prints = [
                "".join(f"{x:016x}" for x in fingerprint(raw[a:b].tobytes(), size, lanes))
                for a, b in itertools.pairwise(at)
            ]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(prints, pa.string())], names=["key", "f"]
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(make, f"key {kind}, f string")


# --- anchors -------------------------------------------------------------------


@functools.cache
def code() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Remainder of each single bit; error patterns of up to 5 bits sorted by
    remainder and weight; and per remainder where its patterns begin, and how many
    have an excess over RADIUS of at most 0, 1, 2."""
    step = np.zeros(BITS, np.int64)
    step[0] = 1
    for i in range(1, BITS):
        step[i] = step[i - 1] << 1
        if step[i] >> (BITS - 12):
            step[i] ^= GENERATOR
    found = []
    for weight in range(RADIUS + 3):
        chosen = list(itertools.combinations(range(BITS), weight))
        picks = np.array(chosen, np.int64).reshape(len(chosen), weight)
        pattern = (np.int64(1) << picks).sum(axis=1)
        remainder = np.bitwise_xor.reduce(step[picks], axis=1)
        found.append(np.stack([remainder, np.full(len(pattern), max(0, weight - RADIUS)), pattern]))
    remainder, excess, pattern = np.concatenate(found, axis=1)
    order = np.lexsort([excess, remainder])
    remainder, excess, pattern = remainder[order], excess[order], pattern[order]
    begin = np.searchsorted(remainder, np.arange(2048))
    upto = np.stack([np.bincount(remainder[excess <= e], minlength=2048) for e in range(3)])
    return step, pattern, begin, upto


def remainders(values: np.ndarray) -> np.ndarray:
    step = code()[0]
    out = np.zeros(len(values), np.int64)
    for i in range(BITS):
        out ^= np.where((values >> i) & 1, step[i], 0)
    return out


def homes(values: np.ndarray) -> np.ndarray:
    """The code word within RADIUS of each 23-bit value."""
    _, pattern, begin, _ = code()
    return values ^ pattern[begin[remainders(values)]]


def visits(parts: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and anchor of every place of the rows, whose blocks are ``parts``:
    anchors of one code word a block whose excesses add up to ``most`` at most."""
    _, pattern, begin, upto = code()
    rest = [remainders(p) for p in parts]
    rows, anchors = [], []
    for excess in itertools.product(range(most + 1), repeat=len(parts)):
        if sum(excess) > most:
            continue
        first = [begin[r] + (upto[e - 1][r] if e else 0) for r, e in zip(rest, excess, strict=True)]
        count = [upto[e][r] - (upto[e - 1][r] if e else 0) for r, e in zip(rest, excess, strict=True)]
        total = np.prod(count, axis=0)
        row = np.repeat(np.arange(len(total)), total)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
        anchor = np.zeros(len(row), np.int64)
        for part, at, n in zip(parts, first, count, strict=True):
            n_here = n[row]
            anchor = (anchor << BITS) | (part[row] ^ pattern[at[row] + inner % n_here])
            inner //= n_here
        rows.append(row)
        anchors.append(anchor)
    return np.concatenate(rows), np.concatenate(anchors)


def joined(codes: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(codes[0]), np.int64)
    for c in codes:
        out = (out << BITS) | c
    return out


def lanes_of(column: pa.Array, lanes: int) -> np.ndarray:
    """Rows of ``lanes`` unsigned numbers from hex fingerprints."""
    raw = bytes.fromhex("".join(column.to_pylist()))
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, lanes)


# --- 64 bits, exactly -----------------------------------------------------------

HALVES = (0, 23)


def halves(prints: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << BITS) - 1)
    return [((prints >> np.uint64(shift)) & mask).astype(np.int64) for shift in HALVES]


def links_64(prints: DataFrame, most: int = 2) -> DataFrame:
    """All pairs ``a, b`` of the distinct fingerprints ``f`` (hex) that differ in
    1 to ``most`` bits, each pair once. ``most`` is at most 2."""
    if most > 2:
        raise ValueError("the anchors cover a threshold of 2")
    signed = pa.int64()

    def places(home: bool):
        def make(batches):
            for batch in batches:
                f = lanes_of(batch.column(0), 1)[:, 0]
                for low in range(0, len(f), 4096):
                    own = f[low : low + 4096]
                    if home:
                        row, anchor = np.arange(len(own)), joined([homes(p) for p in halves(own)])
                    else:
                        row, anchor = visits(halves(own), most)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor, signed), pa.array(own[row].view(np.int64), signed)],
                        names=["anchor", "p"],
                    )

        return prints.mapInArrow(make, "anchor bigint, p bigint")

    at_home = places(True).withColumnRenamed("p", "q")
    differ = F.bit_count(F.col("p").bitwiseXOR(F.col("q")))
    pairs = places(False).join(at_home, "anchor").where((F.col("p") < F.col("q")) & (differ <= most))
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    # The two directions of a pair meet at two anchors.
    return pairs.select(digits("p").alias("a"), digits("q").alias("b")).distinct()


def near_fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, most: int = 2
) -> DataFrame:
    """One row per document: key, fingerprint, component_id."""
    prints = written(fingerprints(docs, key, text, size))
    distinct = written(prints.groupBy("f").agg(F.min("key").alias("least"), F.count("*").alias("n")))
    return grouped(prints, distinct, links_64(distinct.select("f"), most), key)


def grouped(prints: DataFrame, distinct: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """Component of every document from the links of fingerprints."""
    roots = written(components(links))
    least = roots.join(distinct.withColumnRenamed("f", "node"), "node").groupBy("root").agg(
        F.min("least").alias("component_id")
    )
    linked = roots.join(least, "root").select(F.col("node").alias("f"), "component_id")
    # Alone, a fingerprint's component is its documents.
    whole = written(
        distinct.join(linked, "f", "left").select(
            "f", F.coalesce("component_id", "least").alias("component_id"), "n"
        )
    )
    return look_up(prints, whole, "f", "n").select(
        F.col("key").alias(key), F.col("f").alias("fingerprint"), "component_id"
    )


# --- 256 bits, by similarity ------------------------------------------------------

LANES = 4
BLOCKS = 11
# Of 256: 0.8 of Jaccard similarity makes 39 bits differ, give or take 6.
MOST = 56
LEAST = 0.8
# Texts, and their bytes, that a block of a large gathering has on the average.
TEXTS = 1024
BYTES = 8 << 20


def block(prints: np.ndarray, b: int) -> np.ndarray:
    """Bits 23 b .. 23 b + 22 of rows of lanes."""
    lane, shift = divmod(b * BITS, 64)
    value = prints[:, lane] >> np.uint64(shift)
    if shift > 64 - BITS:
        value = value | (prints[:, lane + 1] << np.uint64(64 - shift))
    return (value & np.uint64((1 << BITS) - 1)).astype(np.int64)


def forest(home: np.ndarray, visitor: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Few links that connect all homes and visitors connected by pairs of at
    most ``most`` differing bits. Compared in blocks of bounded size."""
    out = []
    width = max(64, (1 << 20) // max(1, len(home)))
    for low in range(0, len(visitor), width):
        some = visitor[low : low + width]
        differ = np.zeros((len(home), len(some)), np.uint16)
        for lane in range(home.shape[1]):
            differ += np.bitwise_count(home[:, lane, None] ^ some[None, :, lane])
        near = differ <= most
        if not near.any():
            continue
        label = np.arange(len(home))
        while True:
            of_visitor = np.where(near, label[:, None], len(home)).min(axis=0)
            of_home = np.where(near, of_visitor[None, :], len(home)).min(axis=1)
            new = np.minimum(label, of_home)
            if (new == label).all():
                break
            label = new
        met = np.flatnonzero(of_visitor < len(home))
        out.append((some[met], home[of_visitor[met]]))
        moved = np.flatnonzero(label != np.arange(len(home)))
        out.append((home[moved], home[label[moved]]))
    return out


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one key after the other, from batches sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in itertools.pairwise(cuts):
            if held and held[-1].column(0)[0] != batch.column(0)[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def links_256(prints: DataFrame, most: int = MOST, excess: int = 1) -> DataFrame:
    """Links ``a, b`` that connect the fingerprints which are close."""
    names = [f"p{i}" for i in range(LANES)]

    def places(batches):
        for batch in batches:
            f = lanes_of(batch.column(0), LANES)
            for low in range(0, len(f), 2048):
                own = f[low : low + 2048]
                for b in range(BLOCKS):
                    part = block(own, b)
                    row, anchor = visits([part], excess)
                    away = np.ones(len(row), bool)
                    away[np.flatnonzero(anchor == homes(part)[row])] = False
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((b << BITS) | anchor, pa.int64()),
                            pa.array(away),
                            *(pa.array(own[row, i].view(np.int64)) for i in range(LANES)),
                        ],
                        names=["place", "away", *names],
                    )

    def compare(batches):
        for group in by_key(batches):
            away = group.column(1).to_numpy()
            f = np.stack([group.column(2 + i).to_numpy() for i in range(LANES)], axis=1)
            home = f[~away]
            if not len(home) or len(f) < 2:
                continue
            for a, b in forest(home.view(np.uint64), f.view(np.uint64), most):
                other = (a != b).any(axis=1)
                texts = [
                    ["".join(f"{x:016x}" for x in row) for row in side[other].tolist()] for side in (a, b)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()) for t in texts], names=["a", "b"])

    spread = prints.mapInArrow(
        places, "place bigint, away boolean, " + ", ".join(f"{n} bigint" for n in names)
    )
    return (
        spread.repartition("place")
        .sortWithinPartitions("place")
        .mapInArrow(compare, "a string, b string")
        .distinct()
    )


def set_prints(rows: DataFrame, size: int) -> DataFrame:
    """``key, mark, f, bytes`` of ``key, mark, text``; ``f`` is the fingerprint of
    the set of shingles, 16 hex digits a lane, and then a 128-bit hash of the set."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, at in blocks(batches, "text"):
            prints = []
            for a, b in itertools.pairwise(at):
                hashes = np.unique(shingle_hashes(raw[a:b].tobytes(), size))
                prints.append(
                    "".join(f"{x:016x}" for x in lanes_from(hashes, LANES))
                    + xxhash.xxh3_128_hexdigest(hashes.tobytes())
                )
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(prints, pa.string()), pa.array(np.diff(at), pa.int64())],
                names=["key", "mark", "f", "bytes"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(make, f"key {kind}, mark bigint, f string, bytes bigint")


def similar(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Few pairs of a Jaccard similarity of ``least`` and more that connect all
    the sets connected by such pairs."""
    size = np.array([len(x) for x in sets])
    filled = np.flatnonzero(size)
    if len(filled) < 2:
        return []
    ids = np.unique(np.concatenate([sets[k] for k in filled]), return_inverse=True)[1]
    begin = np.concatenate([[0], np.cumsum(size[filled])])
    label, out, mine = np.arange(len(filled)), [], np.zeros(ids.max() + 1, bool)
    for k, own in enumerate(size[filled]):
        mine[ids[begin[k] : begin[k + 1]]] = True
        both = np.add.reduceat(mine[ids], begin[:-1], dtype=np.int64)
        mine[ids[begin[k] : begin[k + 1]]] = False
        union = own + size[filled] - both
        near = (both >= least * union - 1e-9) & (label != label[k])
        for other in np.flatnonzero(near):
            if label[other] != label[k]:
                out.append((int(filled[k]), int(filled[other])))
                label[label == label[other]] = label[k]
        if (label == label[0]).all():
            break
    return out


def verified(rows: DataFrame, members: DataFrame, size: int, least: float) -> DataFrame:
    """Links ``a, b`` that connect the ``members`` (f, key, mark, root, parts) of
    one root whose texts, in ``rows``, are connected by similar ones."""
    own = members.select(
        F.col("key").alias("its_key"),
        F.col("mark").alias("its_mark"),
        "f",
        "root",
        "parts",
        F.pmod(F.xxhash64("f"), "parts").alias("i"),
    )
    same = F.col("key").eqNullSafe(F.col("its_key")) & (F.col("mark") == F.col("its_mark"))
    texts = rows.join(own, same).select("f", "text", "root", "parts", "i").dropDuplicates(["f"])
    others = F.filter(
        F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1),
        lambda j: (F.col("parts") == 1) | (j != F.col("i")),
    )
    dealt = texts.withColumn("j", F.explode(others)).select(
        F.xxhash64("root", F.least("i", "j"), F.greatest("i", "j")).alias("place"), "f", "text"
    )

    def compare(batches):
        for group in by_key(batches):
            if group.num_rows < 2:
                continue
            names = group.column(1).to_pylist()
            sets = [
                np.unique(shingle_hashes((t.as_py() or "").encode(), size)) for t in group.column(2)
            ]
            met = similar(sets, least)
            if met:
                sides = [pa.array([names[k] for k in side], pa.string()) for side in zip(*met, strict=True)]
                yield pa.RecordBatch.from_arrays(sides, names=["a", "b"])

    return (
        dealt.repartition("place")
        .sortWithinPartitions("place")
        .mapInArrow(compare, "a string, b string")
        .distinct()
    )


def near_texts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = 5,
    most: int = MOST,
    least: float = LEAST,
) -> DataFrame:
    """One row per document: key, fingerprint (256 bits), component_id."""
    rows = docs.select(
        F.col(key).alias("key"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"),
        F.col(text).alias("text"),
    )
    prints = written(set_prints(rows, size))
    distinct = written(
        prints.groupBy("f").agg(
            F.min("key").alias("least"),
            F.count("*").alias("n"),
            F.min(F.struct("key", "mark")).alias("one"),
            F.max("bytes").alias("bytes"),
        )
    )
    nodes = distinct.withColumn("node", F.substring("f", 1, 16 * LANES))
    close = components(links_256(nodes.select(F.col("node").alias("f")).distinct(), most))
    gathered = written(
        nodes.join(close, "node", "left").select(
            "f", "one.key", "one.mark", "bytes", F.coalesce("root", "node").alias("root")
        )
    )
    parts = F.greatest(F.ceil(F.count("*") / TEXTS), F.ceil(F.sum("bytes") / BYTES), F.lit(1))
    sizes = written(
        gathered.groupBy("root").agg(F.count("*").alias("n"), parts.alias("parts")).where("n > 1")
    )
    links = written(verified(rows, look_up(gathered, sizes, "root", "n"), size, least))
    return grouped(prints, distinct, links, key).withColumn(
        "fingerprint", F.substring("fingerprint", 1, 16 * LANES)
    )
