"""Importance resampling: documents are drawn by how much likelier the target
makes their features than the corpus does.

Features are runs of one to ``max_n`` consecutive words, hashed into buckets by the
CRC-32 of their bytes. The vocabulary has a head and a tail. The head is broadcast:
the CRC states of the ``HEAD`` most frequent words, and the buckets of the ``HEAD``
most frequent pairs of them when runs are longer than one word. A word of the head
costs one look-up, a run that begins with one goes on from its state; every other
feature takes its CRC directly. Both feed the same bucket totals, so the totals are
exact whatever is in the head.

Head candidates are the words (pairs) that make up one in ``HEAD`` of any block of
texts; a word with that share of all words has it in some block, so none is missed.
Words of more than ``LONG`` bytes stay in the tail, which bounds the broadcast.

A null text has no words, no features, weight 0. A null key hashes as an empty one
and comes last among ties. Rows are drawn each for itself, also repeated ones; rows
that tie in all columns share a run of ranks. An empty table gives an empty result;
an empty target counts as one without features. Other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplemill.llm.common import BLOCK_BYTES
from triplemill.operators.ranking import rank_within
from triplemill.plans.scratch import written

HEAD = 20_000
LONG = 64
# Bytes of text whose words are in memory at a time.
PIECE = 1 << 20

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def word_lists(text: str | None) -> Iterator[list[bytes]]:
    """Words of a whole text in order, a piece of the text at a time. Only A-Z are
    lower-cased; no word is cut."""
    raw = (text or "").encode().lower()
    begin = 0
    while begin < len(raw):
        end = len(raw)
        if end - begin > PIECE and (gap := GAP.search(raw, begin + PIECE)):
            end = gap.end()
        yield WORDS.findall(raw, begin, end)
        begin = end


def runs(text: str | None, n: int) -> Iterator[tuple[bytes, ...]]:
    """Runs of ``n`` consecutive words."""
    before: list[bytes] = []
    for words in word_lists(text):
        words = before + words
        yield from zip(*(words[i:] for i in range(n)), strict=False)
        before = words[max(0, len(words) - n + 1) :] if n > 1 else []


# --- head ---------------------------------------------------------------------


def frequent(texts: DataFrame, n: int) -> list[tuple[bytes, ...]]:
    """The ``HEAD`` most frequent runs of ``n`` words at most, of candidates that
    make up one in ``HEAD`` of some block."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: Counter = Counter()
        size = 0

        def found():
            total = met.total()
            kept = {
                r: k for r, k in met.items() if k * HEAD >= total and max(map(len, r)) <= LONG
            }
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([b" ".join(r) for r in kept], pa.binary()),
                    pa.array(kept.values(), pa.int64()),
                ],
                names=["run", "n"],
            )

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                met.update(runs(text, n))
                size += len(text or "")
                if size >= BLOCK_BYTES:
                    yield found()
                    met.clear()
                    size = 0
        if met:
            yield found()

    counted = texts.mapInArrow(candidates, "run binary, n bigint").groupBy("run").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "run").limit(HEAD).collect()
    return [tuple(bytes(r["run"]).split(b" ")) for r in rows]


class Buckets:
    """Bucket of every feature of a text, through the head where it has it."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]], max_n: int, n_buckets: int):
        self.max_n, self.n_buckets = max_n, n_buckets
        self.states = {w: zlib.crc32(w) for w in words}
        self.of_word = {w: s % n_buckets for w, s in self.states.items()}
        self.of_pair = {p: self.crc(p) % n_buckets for p in pairs}

    def crc(self, run: tuple[bytes, ...]) -> int:
        """CRC of the words joined by spaces, from the state of the first one."""
        state = self.states.get(run[0])
        if state is None:
            state = zlib.crc32(run[0])
        for word in run[1:]:
            state = zlib.crc32(word, zlib.crc32(b" ", state))
        return state

    def of(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of words, and the buckets of all features, repeats included."""
        n_words, parts = 0, []
        for words in word_lists(text):
            n_words += len(words)
            found = list(map(self.of_word.get, words))
            if None in found:
                n, crc = self.n_buckets, zlib.crc32
                found = [crc(w) % n if b is None else b for b, w in zip(found, words, strict=True)]
            parts.append(np.array(found, np.int32))
        for n in range(2, self.max_n + 1):
            known = self.of_pair if n == 2 else {}
            longer = []
            for run in runs(text, n):
                bucket = known.get(run)
                longer.append(self.crc(run) % self.n_buckets if bucket is None else bucket)
            parts.append(np.array(longer, np.int32))
        return n_words, np.concatenate(parts) if parts else np.zeros(0, np.int32)


# --- totals -------------------------------------------------------------------


def hashed(rows: DataFrame, shared, max_n: int, n_buckets: int) -> DataFrame:
    """``key, n_words, n_features, buckets`` (numbers of 4 bytes) of ``key, text``."""
    kind = rows.schema["key"].dataType.simpleString()

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(*shared.value, max_n, n_buckets)

        def done(keys, found):
            return pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays(keys),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([len(b) for _, b in found], pa.int64()),
                    pa.array([b.tobytes() for _, b in found], pa.binary()),
                ],
                names=["key", "n_words", "n_features", "buckets"],
            )

        for batch in batches:
            keys, found, size = [], [], 0
            for i, text in enumerate(batch.column(1)):
                keys.append(batch.column(0).slice(i, 1))
                found.append(buckets.of(text.as_py()))
                size += len(found[-1][1])
                if size >= BLOCK_BYTES:
                    yield done(keys, found)
                    keys, found, size = [], [], 0
            if keys:
                yield done(keys, found)

    return rows.mapInArrow(change, f"key {kind}, n_words bigint, n_features bigint, buckets binary")


def totals(features: DataFrame, n_buckets: int) -> np.ndarray:
    """Features in each bucket, over all rows; a task adds up its own first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_py(), np.int32), minlength=n_buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["bucket", "n"]
        )

    parts = features.select("buckets").mapInArrow(add, "bucket int, n bigint")
    out = np.zeros(n_buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    n = len(corpus)
    all_s, all_t = float(corpus.sum() + n), float(target.sum() + n)
    return np.array(
        [
            math.floor(1000 * math.log((float(t + 1) * all_s) / (float(s + 1) * all_t)))
            for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def weighted(features: DataFrame, gain) -> DataFrame:
    """``key, n_words, n_features, weight``: gains added up over a row's features."""
    kind = features.schema["key"].dataType.simpleString()

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bucket = gain.value
        for batch in batches:
            weight = [int(of_bucket[np.frombuffer(v.as_py(), np.int32)].sum()) for v in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(weight, pa.int64())],
                names=["key", "n_words", "n_features", "weight"],
            )

    return features.mapInArrow(change, f"key {kind}, n_words bigint, n_features bigint, weight bigint")


# --- draw ---------------------------------------------------------------------


def noise(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number from a hash of the key, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    max_n: int = 1,
    n_buckets: int = 10_000,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: key, n_features, weight, score, and its rank among
    the ``percent`` of the documents of ``least_words`` words that are drawn, null
    when it is not."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    aim = target.select(F.lit(None).cast("int").alias("key"), F.col(text).alias("text"))
    head = [run[0] for run in frequent(rows.select("text"), 1)]
    pairs = frequent(rows.select("text"), 2) if max_n > 1 else []
    # HEAD entries of LONG bytes a word at most.
    shared = context.broadcast((head, pairs))
    features = written(hashed(rows, shared, max_n, n_buckets))
    aimed = written(hashed(aim, shared, max_n, n_buckets))
    # As many numbers as buckets.
    gain = context.broadcast(gains(totals(features, n_buckets), totals(aimed, n_buckets)))
    scored = written(
        weighted(features, gain).withColumn("score", F.col("weight") + noise(F.col("key"), seed))
    )
    eligible = scored.where(F.col("n_words") >= least_words)
    n_drawn = eligible.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("key"), F.col("n_features"), F.col("weight")]
    ranked = rank_within(eligible, [], order, "rank")
    drawn = F.when(F.col("rank") <= n_drawn, F.col("rank"))
    others = scored.where(F.col("n_words") < least_words)
    return (
        ranked.withColumn("rank", drawn)
        .unionByName(others.withColumn("rank", F.lit(None).cast("bigint")))
        .select(F.col("key").alias(key), "n_features", "weight", "score", "rank")
    )


# The same in SQL, with the CRC table made by its rule (reflected polynomial
# 0xEDB88320) and applied to the distinct words byte by byte.
SQL = r"""
with crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i::bigint, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
  lambda c, x: case when c & 1 = 1 then xor(3988292384::bigint, c >> 1) else c >> 1 end)) as steps),
t as (select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
b as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from benchmark),
f as (select row, unnest(words) as word from t),
v as (select distinct word, hex(encode(word)) as h from (select word from f union all select word from b)),
c as (select word, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(strlen(word)), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::bigint)),
  lambda s, x: xor(steps[(xor(s, x) & 255) + 1], s >> 8)), 4294967295::bigint) % 10000 as bucket from v, crc),
s as (select bucket, count(*) as n from f join c using (word) group by bucket),
a as (select bucket, count(*) as n from b join c using (word) group by bucket),
w as (select coalesce((select sum(n) from s), 0) as all_s, coalesce((select sum(n) from a), 0) as all_t),
g as (select s.bucket, floor(1000 * ln((coalesce(a.n, 0) + 1)::double * (all_s + 10000)::double / ((s.n + 1)::double * (all_t + 10000)::double)))::bigint as gain
  from s left join a using (bucket), w),
weights as (select row, sum(gain)::bigint as weight from f join c using (word) join g using (bucket) group by row),
scored as (select t.row, doc_id, len(words)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[1:8])::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from t left join weights using (row)),
ranked as (select row, row_number() over (order by score desc, doc_id nulls last, n_features, weight) as rank,
  count(*) over () * 10 // 100 as n_drawn from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= n_drawn then rank end as rank
from scored left join ranked using (row)
"""
