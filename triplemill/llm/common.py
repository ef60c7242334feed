"""What the operators of this folder share: words, blocks of Arrow rows, running
sums and look-ups that stay whole when one key holds most rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triplemill.plans.scratch import written

BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
# Text that a task turns into numpy arrays at a time.
BLOCK_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def tag(value: Column) -> Column:
    """Text of a value that tells null from every value: ``n`` or ``v...``."""
    return F.when(value.isNull(), "n").otherwise(F.concat(F.lit("v"), value.cast("string")))


def same_row(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Condition that the columns agree, null with null."""
    out = F.lit(True)
    for name in names:
        out = out & a[name].eqNullSafe(b[name])
    return out


# --- Arrow ----------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one array of bytes, and where each begins and
    ends. A null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(
    batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in pieces of about ``most`` bytes of text, one text at least, each
    with its bytes and offsets. No text is cut."""
    for batch in batches:
        raw, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        row, n = 0, batch.num_rows
        while row < n:
            end = int(np.searchsorted(at, at[row] + most, side="right")) - 1
            end = min(n, max(end, row + 1))
            yield (
                batch.slice(row, end - row),
                raw[at[row] : at[end]],
                at[row : end + 1] - at[row],
            )
            row = end


IS_BLANK = np.zeros(256, bool)
IS_BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(raw: np.ndarray, at: np.ndarray, blank=IS_BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word; words do not run from one text into the next."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~blank[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


_POWERS = np.ones(1, np.uint64)


def powers(n: int, base: int = 0x100000001B3) -> np.ndarray:
    """``base ** i`` modulo 2^64 for ``i < n``."""
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(
                np.concatenate([[1], np.full(max(n, 256) - 1, base)]).astype(np.uint64),
                dtype=np.uint64,
            )
    return _POWERS[:n]


def word_hashes(raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, of some words at a time."""
    if not len(first):
        return np.zeros(0, np.uint64)
    if len(first) > 16_384:
        cuts = range(0, len(first), 16_384)
        return np.concatenate([word_hashes(raw, first[c : c + 16_384], end[c : c + 16_384]) for c in cuts])
    size = end - first
    inside = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    place = np.arange(len(inside)) + inside
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    power = powers(int(size.max()))[place - np.repeat(first, size)]
    total = np.add.reduceat((raw[place].astype(np.uint64) + np.uint64(1)) * power, begin)
    return mix(total ^ (size.astype(np.uint64) << np.uint64(48)))


# --- skew -------------------------------------------------------------------


def running(
    df: DataFrame, keys: list[str], order: list[str], amount: str, rank="rank", before="before"
) -> DataFrame:
    """Rank (from 0) and sum of ``amount`` before each row, within ``keys`` by
    ``order``, for keys of any size.

    Rows are laid out in ranges, so a large key spans many partitions; each
    range is summed up, and only one row per key and range goes through a window.
    The rows are written first: both readings see the same ranges, also when
    executors are lost.
    """
    laid = written(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
    )
    pieces = laid.groupBy(*keys, "_part").agg(
        F.count("*").alias("_rows"), F.sum(amount).alias("_amount")
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    ahead = pieces.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.col("_part").alias("_its"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).alias("_amount_before"),
    )
    own = Window.partitionBy(*keys, "_part").orderBy(*order)
    up_to = own.rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_part") == F.col("_its")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return (
        laid.withColumn("_at", F.row_number().over(own) - 1)
        .withColumn("_sum", F.coalesce(F.sum(amount).over(up_to), F.lit(0)))
        .join(ahead, same)
        .withColumn(rank, (F.col("_at") + F.col("_rows_before")).cast("bigint"))
        .withColumn(before, (F.col("_sum") + F.col("_amount_before")).cast("bigint"))
        .drop("_part", "_its", "_at", "_sum", "_rows_before", "_amount_before")
        .drop(*[f"_{k}" for k in keys])
    )


# A key with this share of all rows or more is looked up apart from the others;
# there are at most ONE_IN such keys, so their table is small at any scale.
ONE_IN = 2_000


def look_up(
    rows: DataFrame, table: DataFrame, key: str, count: str, how: str = "inner"
) -> DataFrame:
    """Join (inner or left) of ``rows`` with ``table`` (one row per key, ``count``
    saying how many of ``rows`` have the key), when some keys are very frequent.

    Frequent keys, at most ONE_IN of them by definition, are broadcast with
    their entries; the others are shuffled, none with more than 1 / ONE_IN of
    the rows. ``table`` should be a written one, for it is read three times.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    if not total:
        return rows.join(table.drop(count), key, how)
    hot = table.where(F.col(count) * ONE_IN >= F.lit(total))
    rest = table.where(F.col(count) * ONE_IN < F.lit(total)).drop(count)
    if hot.isEmpty():
        return rows.join(rest, key, how)
    names = F.broadcast(hot.select(key))
    frequent = rows.join(F.broadcast(hot.drop(count)), key)
    return frequent.unionByName(rows.join(names, key, "left_anti").join(rest, key, how))
