"""Passages of lines that repeat anywhere, removed but for their first place.

A passage is a run of two or more lines that hold words, with the blank lines
between them, or one line of more than ``LONG`` words; shorter single lines stay.
The lines that go are those of every run, in its full length, that an earlier place
has (least id, then place), whatever stands around it. By the same order each line
that goes stays somewhere. Where a line repeats within its own run (a, a, a), the
first stays.

Lines are cut into content-defined chunks: a hash that rolls over the hashes of
``ROLL`` lines ends a chunk after each line where it is divisible by ``MEAN``, so
chunks of a shared passage agree whatever stands before it. Chunks of two lines and
more that repeat go but for their first place. A chunk that has no copy may still
have a part in common with another, at its ends or as a short passage that holds no
boundary. So what is left, first places and the seams between chunks too, is met in
the least chunks there are, each line with the next one and each long line alone:
a run of lines is shared exactly if all its pairs are. The chunks take whole
passages and copies out beforehand; that changes no result, for the first place of
each pair is in a first place of its chunk.

Chunks and pairs are met by a 128-bit hash, of narrow rows that are added up before
they are shuffled; what repeats is then compared byte by byte: per hash the least
and the greatest text are taken (also added up before the shuffle), and a hash that
stands for different texts is left alone. Texts are shuffled once, to be joined with
the places of what repeats in them. A chunk or pair that is very frequent is looked
up apart.

A null text has no lines and stays null; a document of which everything goes
stays with an empty text; rows with equal id and text are one document, all of
them stay or lose the same; an empty table gives an empty result. Other columns
are carried along unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from triplemill.llm.common import look_up
from triplemill.plans.scratch import written

ROLL = 2
MEAN = 4
LONG = 50  # words; a line of more is a passage by itself

CHUNK, PAIR = 0, 1


class Cut:
    """Chunks and pairs of a text, as (first line, end) in their order.

    ``chunks`` has all of them, also of one line. ``pairs`` (and long lines) are
    numbered; each chunk in turn has those that lie in it, of which there are
    ``inner``, and then ``seams``, that run into the next one or are all that a chunk
    of one line has.
    """

    def __init__(self, text: str | bytes | None):
        raw = text if isinstance(text, bytes) else (text or "").encode()
        self.lines = raw.split(b"\n")
        full = [i for i, line in enumerate(self.lines) if line.strip(b" \t\n\x0b\x0c\r")]
        self.chunks: list[tuple[int, int]] = []
        self.pairs: list[tuple[int, int]] = []
        self.inner: list[int] = []
        self.seams: list[int] = []
        begin, last, own = 0, [0] * ROLL, 0
        for j, i in enumerate(full):
            line = self.lines[i]
            if j:
                # A pair with the line before: a seam of the last chunk, or inner.
                if j > begin:
                    own += 1
                else:
                    self.seams[-1] += 1
                self.pairs.append((full[j - 1], i + 1))
            if len(line.split()) > LONG:
                own += 1
                self.pairs.append((i, i + 1))
            last = [*last[1:], xxhash.xxh64_intdigest(line, ROLL)]
            rolled = sum(h * (2 * k + 3) for k, h in enumerate(last)) % 2**64
            if (rolled >> 20) % MEAN == 0 or j + 1 == len(full):
                alone = j == begin
                self.chunks.append((full[begin], i + 1))
                self.inner.append(0 if alone else own)
                self.seams.append(own if alone else 0)
                begin, own = j + 1, 0

    def bytes_of(self, kind: int, number: int) -> bytes:
        a, b = self.span(kind, number)
        return b"\n".join(self.lines[a:b])

    def span(self, kind: int, number: int) -> tuple[int, int]:
        return (self.chunks if kind == CHUNK else self.pairs)[number]


HASH = 16


def places(docs: DataFrame) -> DataFrame:
    """One row per chunk of ``key, mark, text``: its number ``begin``, its hash
    ``h`` (null for one line), the number of its ``first`` pair, how many are
    ``inner``, and the hashes of these and of its seams end to end."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for i, text in enumerate(batch.column(2)):
                own, first = Cut(text.as_py()), 0
                pairs = b"".join(xxhash.xxh3_128_digest(own.bytes_of(PAIR, k)) for k in range(len(own.pairs)))
                for c, (inner, seams) in enumerate(zip(own.inner, own.seams, strict=True)):
                    row.append(i)
                    whole = xxhash.xxh3_128_digest(own.bytes_of(CHUNK, c)) if inner else None
                    last = first + inner + seams
                    found.append((c, whole, first, inner, pairs[first * HASH : last * HASH]))
                    first = last
            at = pa.array(row, pa.int64())
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
            columns = list(zip(*found, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    batch.column(1).take(at),
                    *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)),
                ],
                names=["key", "mark", "begin", "h", "first", "inner", "pairs"],
            )

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(
        cut, f"key {kind}, mark bigint, begin bigint, h binary, first bigint, inner int, pairs binary"
    )


def place() -> Column:
    """What sorts the pieces of all documents, a null id last."""
    return F.struct(F.col("key").isNull().alias("none"), "key", "mark", "begin")


def first_places(rows: DataFrame) -> DataFrame:
    """``h, n, least`` of what has more than one place."""
    return written(
        rows.groupBy("h").agg(F.count("*").alias("n"), F.min(place()).alias("least")).where("n > 1")
    )


def repeats(docs: DataFrame) -> DataFrame:
    """Per document what repeats in it: ``key, mark, places`` with structs of kind,
    number, hash, and whether it is a later place."""
    at = written(places(docs))
    alone = at.where("h is null").withColumns({"repeated": F.lit(False), "later": F.lit(False)})
    several = at.where("h is not null")
    known = look_up(several, first_places(several), "h", "n", "left").withColumns(
        {
            "repeated": F.col("least").isNotNull(),
            "later": F.coalesce(place() != F.col("least"), F.lit(False)),
        }
    )
    # Of a later place only the seams are left to be looked at.
    gone = F.when(F.col("later"), F.col("inner")).otherwise(0)
    both = known.drop("least").unionByName(alone).select(
        "key",
        "mark",
        "begin",
        F.when(F.col("repeated"), F.col("h")).alias("h"),
        "later",
        (F.col("first") + gone).alias("first"),
        F.substr("pairs", gone * HASH + 1).alias("pairs"),
    )
    chunks = written(both.where("h is not null or length(pairs) > 0"))
    number = F.explode(F.sequence(F.lit(0), (F.length("pairs") / HASH).cast("int") - 1)).alias("i")
    pairs = (
        chunks.where("length(pairs) > 0")
        .select("key", "mark", "first", "pairs", number)
        .select(
            "key",
            "mark",
            (F.col("first") + F.col("i")).alias("begin"),
            F.substr("pairs", F.col("i") * HASH + 1, F.lit(HASH)).alias("h"),
        )
    )
    later = look_up(pairs, first_places(pairs), "h", "n").withColumn("later", place() != F.col("least"))
    found = chunks.where("h is not null").select("key", "mark", F.lit(CHUNK).alias("kind"), "begin", "h", "later")
    found = found.unionByName(later.select("key", "mark", F.lit(PAIR).alias("kind"), "begin", "h", "later"))
    # As long as the document has pieces; repeated rows give a place more than once.
    return found.groupBy("key", "mark").agg(
        F.collect_set(F.struct("kind", "begin", "h", "later")).alias("places")
    )


def unlike(rows: DataFrame) -> list[bytes]:
    """Hashes that stand for different texts. None in practice: the chance is
    the square of the number of pieces in 2^128."""

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, wanted in zip(batch.column(0), batch.column(1), strict=True):
                own = Cut(zstandard.decompress(data.as_py()))
                met = [(p["h"], own.bytes_of(p["kind"], p["begin"])) for p in wanted.as_py()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.binary()) for x in zip(*met, strict=True)], names=["h", "piece"]
                )

    compared = (
        rows.select("data", "places")
        .where("places is not null and data is not null")
        .mapInArrow(repeated, "h binary, piece binary")
        .groupBy("h")
        .agg(F.min("piece").alias("a"), F.max("piece").alias("b"))
    )
    return [bytes(r["h"]) for r in compared.where("a <> b").select("h").collect()]


def pressed(rows: DataFrame) -> DataFrame:
    """``key, mark, data, others`` of ``key, mark, text, others``: the text goes
    compressed through the shuffle, and lies so in the table behind it."""

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                texts = some.column(2).to_pylist()
                data = [None if t is None else zstandard.compress(t.encode(), 3) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(data, pa.binary()), some.column(3)],
                    names=["key", "mark", "data", "others"],
                )

    fields = [
        StructField("data", BinaryType()) if f.name == "text" else f for f in rows.schema.fields
    ]
    return rows.mapInArrow(press, StructType(fields))


DONE = "text string, n_lines bigint, n_removed bigint, n_chunks bigint"


def deduplicated(
    docs: DataFrame, key: str = "doc_id", text: str = "text", report: str | None = None
) -> DataFrame:
    """All rows and columns, the text without repeated passages; if asked for, a
    column ``report``, a struct of n_lines, n_removed (lines) and n_chunks (stretches
    of lines removed)."""
    others = [c for c in docs.columns if c not in (key, text)]
    held = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("string")
    rows = docs.select(
        F.col(key).alias("key"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"),
        F.col(text).alias("text"),
        held.alias("others"),
    )
    wanted = repeats(rows.select("key", "mark", "text")).withColumnsRenamed(
        {"key": "its_key", "mark": "its_mark"}
    )
    same = F.col("key").eqNullSafe(F.col("its_key")) & (F.col("mark") == F.col("its_mark"))
    joined = written(pressed(rows).join(wanted, same, "left").drop("its_key", "its_mark", "mark"))
    left_alone = set(unlike(joined))

    def cleaned(data: bytes | None, wanted: list[dict] | None) -> tuple:
        if data is None:
            return None, 0, 0, 0
        text = zstandard.decompress(data).decode()
        later = [p for p in wanted or () if p["later"] and bytes(p["h"]) not in left_alone]
        lines = text.split("\n")
        if not later:
            return text, len(lines), 0, 0
        own, gone = Cut(text), [False] * len(lines)
        for p in later:
            a, b = own.span(p["kind"], p["begin"])
            gone[a:b] = [True] * (b - a)
        keep = [line for line, off in zip(lines, gone, strict=True) if not off]
        n_chunks = sum(off and not before for before, off in zip([False, *gone], gone))
        return "\n".join(keep), len(lines), sum(gone), n_chunks

    @F.arrow_udf(f"struct<{DONE}>")
    def without(data: pa.Array, wanted: pa.Array) -> pa.Array:
        done = [cleaned(d.as_py(), w.as_py()) for d, w in zip(data, wanted, strict=True)]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        names = [part.split()[0] for part in DONE.split(", ")]
        columns = list(zip(*done, strict=True)) or [()] * len(names)
        return pa.StructArray.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names
        )

    done = joined.withColumn("done", without("data", "places"))
    back = [
        F.col("key").alias(c) if c == key
        else F.col("done.text").cast(StringType()).alias(c) if c == text
        else F.col("others")[c].alias(c)
        for c in docs.columns
    ]
    if report is not None:
        back.append(F.struct("done.n_lines", "done.n_removed", "done.n_chunks").alias(report))
    return done.select(*back)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_lines, n_removed, n_chunks, kept_sha256."""
    done = deduplicated(docs.select(key, text), key, text, "report")
    return done.select(
        key, "report.*", F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("kept_sha256")
    )
