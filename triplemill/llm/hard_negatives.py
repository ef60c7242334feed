"""Hard negatives of anchors by a secondary-sort shuffle.

Rows and anchors are dealt into blocks of bounded size, and every anchor block
meets every row block in a cell of its own; a cell scores its pairs by one integer
matrix product. A first round of cells finds the positives of each anchor. A second
one passes on, for each positive, the first negatives of the cell in its window of
scores: no other can be among the first of all cells, so nothing is lost and no
anchor sends more than a few rows a cell.

What is passed on is packed into keys (anchor, descending score, positives first,
id), as bytes whose order is the order wanted. ``repartitionAndSortWithinPartitions``
brings the keys of an anchor together in that order, and one pass over the stream
opens a window at each positive and gives negatives to the open windows until they
are full. It holds the open windows of one anchor, never its rows.

Rows with a null key, label, vector or component, or a component that is not
finite, take no part. Repeated rows are rows of their own: each takes part and, if
it is an anchor, has its own results. Vectors may differ in length; missing
components count 0. Scores beyond ``MOST`` raise an error instead of wrapping round.
An empty table, or one without anchors, gives an empty result. Other columns are
not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplemill.plans.scratch import written

# Rows and anchors of a cell.
ROWS = 2_048
ANCHORS = 2_048
# Anchors of a cell that are scored at a time.
TILE = 256
MOST = 1 << 56

PAIRS = "at bigint, anchor_id bigint, score bigint, id bigint"
KEY = ">QQBQ"
TOP, ALL = 1 << 63, (1 << 64) - 1


def usable(rows: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """``at, id, label, v`` of the rows that take part: row number, key, label and
    integer vector."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    plain = F.col(label).cast("bigint")
    moved = F.when(F.col(key) % 7 == 0, (plain + 1) % 10).otherwise(plain)
    return written(
        rows.select(
            F.monotonically_increasing_id().alias("at"),
            F.col(key).cast("bigint").alias("id"),
            moved.alias("label"),
            F.when(finite, F.transform(vector, lambda x: F.floor(256 * x.cast("double")))).alias("v"),
        ).where("id is not null and label is not null and v is not null")
    )


def cells(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int):
    """Both sides dealt out: each row to one row block and every anchor block, each
    anchor to one anchor block and every row block."""
    n_r, n_a = n_rows // ROWS + 1, n_anchors // ANCHORS + 1

    def own(n: int) -> Column:
        return F.pmod(F.xxhash64("at"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = anchors.withColumn("_a", own(n_a)).withColumn("_r", every(n_r))
    right = rows.withColumn("_r", own(n_r)).withColumn("_a", every(n_a))
    return left.groupBy("_a", "_r").cogroup(right.groupBy("_a", "_r"))


# --- a cell ---------------------------------------------------------------------


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def matrix(table: pa.Table) -> np.ndarray:
    """Vectors as rows, short ones filled up with 0."""
    column = table.column("v").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    at = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy().astype(np.int64)[at[0] : at[-1]]
    size = np.diff(at)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` and ``b``, by floating point
    numbers where those hold every sum exactly."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not width:
        return np.zeros((len(a), len(b)), np.int64)
    most = width * max(abs(int(a.min())), int(a.max())) * max(abs(int(b.min())), int(b.max()))
    if most >= MOST:
        raise OverflowError("scores beyond 2^56")
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def in_order(a: np.ndarray, b: np.ndarray, score: np.ndarray):
    """Pairs by anchor, descending score, place of the row."""
    order = np.lexsort((b, -score, a))
    return a[order], b[order], score[order]


def leading(group: np.ndarray, k: int) -> np.ndarray:
    """Which of sorted groups' members are among the first ``k``."""
    return np.arange(len(group)) - np.searchsorted(group, group, "left") < k


def found(anchors: pa.Table, rows: pa.Table, pick) -> pa.Table:
    """Pairs that ``pick`` chooses, a tile of anchors at a time. Rows stand in the
    order of their ids, so places break ties as ids do."""
    rows = rows.sort_by([("id", "ascending"), ("at", "ascending")])
    out = []
    if len(anchors) and len(rows):
        v, w = matrix(anchors), matrix(rows)
        for low in range(0, len(anchors), TILE):
            tile = anchors.slice(low, TILE)
            a, b, score = pick(tile, rows, products(v[low : low + TILE], w))
            out.append((numbers(tile, "at")[a], numbers(tile, "id")[a], score, numbers(rows, "id")[b]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 4
    return pa.table(columns, names=["at", "anchor_id", "score", "id"])


def positives_of(k: int):
    """The first ``k`` other rows of an anchor's label."""

    def pick(anchors, rows, score):
        own, label = numbers(anchors, "at"), numbers(anchors, "label")
        mate = (label[:, None] == numbers(rows, "label")) & (own[:, None] != numbers(rows, "at"))
        if score.shape[1] > k:
            low = np.where(mate, score, -MOST)
            least = np.partition(low, -k, axis=1)[:, -k]
            mate &= score >= least[:, None]
        a, b = np.nonzero(mate)
        a, b, s = in_order(a, b, score[a, b])
        first = leading(a, k)
        return a[first], b[first], s[first]

    return lambda anchors, rows: found(anchors, rows, pick)


def negatives_of(k: int, low: int, high: int):
    """The first ``k`` rows of other labels in the window of each positive."""

    def pick(anchors, rows, score):
        each = [np.sort(np.array(p, np.int64))[::-1] for p in anchors.column("positives").to_pylist()]
        most, least = np.array([p[0] for p in each]), np.array([p[-1] for p in each])
        # A window is empty unless its positive's score is 0 or more.
        least = np.maximum(least, 0)[:, None]
        near = (100 * score >= low * least) & (100 * score <= high * most[:, None])
        near &= numbers(anchors, "label")[:, None] != numbers(rows, "label")
        a, b = np.nonzero(near)
        a, b, s = in_order(a, b, score[a, b])
        keep = np.zeros(len(a), bool)
        for i in range(max(map(len, each), default=0)):
            # -1 has an empty window.
            p = np.array([e[i] if i < len(e) else -1 for e in each])[a]
            inside = np.flatnonzero((100 * s >= low * p) & (100 * s <= high * p))
            keep[inside[leading(a[inside], k)]] = True
        return a[keep], b[keep], s[keep]

    return lambda anchors, rows: found(anchors, rows, pick)


# --- secondary sort --------------------------------------------------------------


def packed(at: int, score: int, kind: int, key: int) -> bytes:
    """Bytes in the order of anchor, descending score, kind, id."""
    return struct.pack(KEY, at, ALL - (score + TOP), kind, key + TOP)


def unpacked(key: bytes) -> tuple[int, int, int, int]:
    at, score, kind, own = struct.unpack(KEY, key)
    return at, ALL - score - TOP, kind, own - TOP


def mined(
    records: Iterator[tuple[bytes, int]], k: int, low: int, high: int
) -> Iterator[tuple]:
    """One pass over sorted keys: positives open windows, negatives fill them."""
    anchor, windows = None, []
    for key, anchor_id in records:
        at, score, kind, own = unpacked(key)
        if at != anchor:
            anchor, windows = at, []
        if kind == 0:
            windows.append([own, score, 0])
            continue
        # Full windows are closed, and so are those whose scores lie behind.
        windows = [w for w in windows if w[2] < k and 100 * score >= low * w[1]]
        for window in windows:
            if 100 * score <= high * window[1]:
                window[2] += 1
                yield anchor_id, window[0], window[2], own, window[1], score


def hard_negatives(
    rows: DataFrame,
    n_positives: int = 5,
    n_negatives: int = 5,
    low: int = 80,
    high: int = 100,
    every: int = 100,
    key: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score)``: for each anchor (key divisible by ``every``) and each of its
    first positives, the first negatives whose score is ``low`` to ``high`` percent
    of the positive's. ``high`` may be 100 at most."""
    if high > 100 or low < 0:
        raise ValueError("windows lie from 0 to 100 percent of the positive's score")
    spark = rows.sparkSession
    all_rows = usable(rows, key, label, vector)
    anchors = all_rows.where(F.col("id") % every == 0)
    n_rows, n_anchors = all_rows.count(), anchors.count()
    near = cells(all_rows, anchors, n_rows, n_anchors).applyInArrow(positives_of(n_positives), PAIRS)
    best = Window.partitionBy("at").orderBy(F.desc("score"), "id")
    positives = written(
        near.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= n_positives).drop("_n")
    )
    bars = positives.groupBy("at").agg(F.collect_list("score").alias("positives"))
    asking = written(anchors.join(bars, "at"))
    negatives = cells(all_rows, asking, n_rows, n_anchors).applyInArrow(
        negatives_of(n_negatives, low, high), PAIRS
    )
    both = positives.withColumn("kind", F.lit(0)).unionByName(negatives.withColumn("kind", F.lit(1)))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    records = both.select("at", "score", "kind", "id", "anchor_id").rdd.map(
        lambda r: (packed(r[0], r[1], r[2], r[3]), r[4])
    )
    stream = records.repartitionAndSortWithinPartitions(
        n_parts, lambda k: zlib.crc32(k[:8])
    ).mapPartitions(lambda part: mined(part, n_negatives, low, high))
    return spark.createDataFrame(
        stream,
        "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
        "positive_score bigint, negative_score bigint",
    )


SQL = """
with r as (select row_number() over () as place, vec_id as id,
  case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label,
  list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.place, a.id as anchor_id, b.place as other, b.id, a.label = b.label as mate,
  list_inner_product(a.v, b.v)::bigint as score
  from r a join r b on a.place <> b.place where a.id % 100 = 0),
p as (select place, anchor_id, other, id, score from s where mate
  qualify row_number() over (partition by place order by score desc, id) <= 5),
n as (select p.anchor_id, p.id as positive_id, s.id as negative_id, p.score as positive_score, s.score as negative_score,
  row_number() over (partition by p.place, p.other order by s.score desc, s.id) as rank
  from p join s on s.place = p.place and not s.mate and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""
