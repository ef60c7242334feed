"""Ranks and ordered groups that stay whole when one key holds most rows."""

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplemill.constants import SPLIT_RATIOS, SPLIT_SEED, SPLITS
from triplemill.functions.arrays import SEP, bind
from triplemill.plans.scratch import written

# A key with more rows than this is hot; it is cut into pieces of CHUNK rows.
HOT_ROWS = 200_000
CHUNK = 50_000


def seeded_hash(*cols, seed: int):
    """Uniform text hash, the same for a seed whatever the partitioning."""
    return F.md5(F.concat_ws(SEP, *cols, F.lit(str(seed))))


def rank_within(df: DataFrame, keys: list[str], order: list[str], name="rank") -> DataFrame:
    """Row number (from 1) within ``keys`` by ``order``, for keys of any size.

    Rows are laid out in sorted ranges of ``keys + order``, so a large group
    spans several partitions, and numbered there. Where a group's part begins
    and how many rows the parts before it have turn that number into the rank.
    """
    laid = written(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    # The upper bits of the number are the partition.
    laid = laid.withColumn("_part", F.shiftright("_at", 33))
    pieces = laid.groupBy(*keys, "_part").agg(
        F.count("*").alias("_n"), F.min("_at").alias("_first")
    )
    # One row per key and partition: no window here is longer than the number
    # of partitions.
    before = (
        Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ).orderBy("_part")
    shifts = pieces.select(
        *(F.col(k).alias(f"_its_{k}") for k in keys),
        F.col("_part").alias("_its_part"),
        (F.sum("_n").over(before) - F.col("_n") - F.col("_first") + 1).alias("_shift"),
    )
    same = F.col("_part") == F.col("_its_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_its_{k}"))
    return (
        laid.join(shifts, same)
        .withColumn(name, (F.col("_at") + F.col("_shift")).cast("bigint"))
        .drop("_at", "_part", "_shift", "_its_part", *(f"_its_{k}" for k in keys))
    )


# Rows of a task when rows are laid out by key.
PART_ROWS = 250_000


def laid_by(df: DataFrame, keys: list[str], hot: DataFrame | None, rows: int) -> DataFrame:
    """The ``rows`` rows partitioned by ``keys``, in as many parts as their number
    asks for, so that what is done per key needs no other shuffle and a task's share
    does not grow with the table. With hot keys they are left as they are."""
    return df.repartition(rows // PART_ROWS + 1, *keys) if hot is None else df


def ranked_rows(
    df: DataFrame, keys: list[str], order: list[str], name: str, hot: DataFrame | None
) -> DataFrame:
    """``rank_within`` where only the ``hot`` keys (None: none) are large: the others
    are numbered in a window, in place if the rows are already partitioned by key."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    if hot is None:
        return df.withColumn(name, number)
    ordinary = df.join(hot, hot.columns, "left_anti").withColumn(name, number)
    return ordinary.unionByName(
        rank_within(df.join(hot, hot.columns, "left_semi"), keys, order, name)
    )


# Rows of a range that is sorted to find ranks in it, and how many ranges there are
# at most; a range's ends are made from this many sampled rows.
RANGE_ROWS = 500_000
MOST_RANGES = 1_024
SAMPLED = 20
COARSE = 32


class Ranges:
    """Order statistics without sorting the table.

    A bounded sample cuts the order of ``keys + order`` into ranges, and one pass
    counts the rows of each key in each range. These counts, which reach the
    driver, tell the range that holds a rank; only such ranges are sorted. The
    sample decides how much work that is, not the result. ``keys`` must have few
    values; nulls come first.
    """

    def __init__(
        self, df: DataFrame, keys: list[str], order: list[str], range_rows: int = RANGE_ROWS
    ):
        self.keys, self.order = keys, order
        columns = [*keys, *order]
        total = df.count()
        n = min(MOST_RANGES, total // range_rows + 1)
        cuts = self._cuts(df.select(*columns), total, n) if n > 1 else []
        schema = df.select(*columns).schema
        row = F.struct(*columns)

        def literal(cut) -> Column:
            return F.struct(
                *(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(cut, schema, strict=True))
            )

        # Coarse cuts first, then those between two of them.
        coarse = [literal(c) for c in cuts[COARSE - 1 :: COARSE]]
        fine = F.array(*(literal(c) for c in cuts))

        def passed(some: Column, value: Column) -> Column:
            return F.size(F.filter(some, lambda c: c <= value))

        def number(value: Column) -> Column:
            if not cuts:
                return F.lit(0)
            first = passed(F.array(*coarse), value) * COARSE if coarse else F.lit(0)
            return bind(
                first, lambda k: k + passed(F.slice(fine, k + 1, F.lit(COARSE)), value)
            )

        self.rows = df.withColumn("_range", bind(row, number))
        counted = self.rows.groupBy(*keys, "_range").agg(F.count("*").alias("n")).collect()
        self.sizes: dict[tuple, list[tuple[int, int, int]]] = defaultdict(list)
        before: dict[tuple, int] = defaultdict(int)
        for r in sorted(counted, key=lambda r: r["_range"]):
            key = tuple(r[k] for k in keys)
            self.sizes[key].append((r["_range"], before[key], r["n"]))
            before[key] += r["n"]

    @staticmethod
    def _cuts(rows: DataFrame, total: int, n: int) -> list:
        wanted = n * SAMPLED
        sample = rows.sample(min(1.0, wanted / total), 1).orderBy(*rows.columns).collect()
        step = max(1, len(sample) // n)
        return sample[step::step][: n - 1]

    def _ranked(self, parts: list[tuple], name: str) -> DataFrame:
        """Rows of the given ``(*key, range, rows before)`` with their rank."""
        df = self.rows
        fields = [df.schema[k] for k in self.keys]
        schema = ", ".join(
            [*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "_range int, _before bigint"]
        )
        wanted = df.sparkSession.createDataFrame(parts, schema)
        inside = Window.partitionBy(*self.keys, "_range").orderBy(*self.order)
        same = df["_range"] == wanted["_range"]
        for k in self.keys:
            same = same & df[k].eqNullSafe(wanted[k])
        return (
            df.join(wanted, same)
            .select(*(df[c] for c in df.columns), "_before")
            .withColumn(name, F.col("_before") + F.row_number().over(inside))
            .drop("_range", "_before")
        )

    def at(self, ranks: dict[tuple, list[int]], name: str = "rank") -> DataFrame:
        """The rows that have the given ranks (from 1) within their keys."""
        parts, places = [], []
        for key, some in ranks.items():
            todo = sorted(set(some))
            places += [(*key, r) for r in todo]
            for number, before, n in self.sizes.get(key, []):
                if any(before < r <= before + n for r in todo):
                    parts.append((*key, number, before))
        ranked = self._ranked(parts, name)
        fields = [ranked.schema[k] for k in self.keys]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{name}` bigint"])
        wanted = ranked.sparkSession.createDataFrame(places, schema)
        return ranked.join(wanted, [*self.keys, name], "left_semi")

    def first(self, most: int, name: str = "rank") -> DataFrame:
        """The first ``most`` rows of each key with their ranks; no range behind
        them is sorted."""
        parts = [
            (*key, number, before)
            for key, sizes in self.sizes.items()
            for number, before, _ in sizes
            if before < most
        ]
        return self._ranked(parts, name).where(F.col(name) <= most)


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more rows than the threshold, or None when there are none."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    top = sizes.agg(F.max("_n").alias("most")).first()
    if (top["most"] or 0) <= hot_rows:
        return None
    return written(sizes.where(F.col("_n") > hot_rows).select(*keys))


def gather(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    fields: list[str],
    hot: DataFrame | None,
    chunk: int = CHUNK,
) -> DataFrame:
    """One row per key with ``items``: its rows as structs, sorted by ``order``.

    ``fields`` must begin with ``order``. Ordinary keys, which have a bounded
    number of rows, are collected directly, in place if the rows are already
    partitioned by the key. Hot keys are ranked across partitions and collected
    in ordered chunks that only need to be put end to end.
    """
    item = F.struct(*fields)
    if hot is None:
        return df.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))
    ordinary = (
        df.join(hot, keys, "left_anti")
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
    )
    pieces = (
        rank_within(df.join(hot, keys, "left_semi"), keys, order, "_rank")
        .withColumn("_chunk", F.floor((F.col("_rank") - 1) / chunk))
        .groupBy(*keys, "_chunk")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
    )
    joined = pieces.groupBy(*keys).agg(
        F.flatten(
            F.transform(
                F.sort_array(F.collect_list(F.struct("_chunk", "items"))),
                lambda piece: piece["items"],
            )
        ).alias("items")
    )
    return ordinary.unionByName(joined)


def hash_at_rank(df: DataFrame, hash_col: str, rank: int, counts=None) -> str | None:
    """Value of the ``rank``-th smallest hash (from 0), None past the end.

    Narrowed down by counts per three more hex digits, so that only counts (at
    most 4,096 a round) and one value ever reach the driver.
    """
    prefix, left = "", rank
    while True:
        for bucket, n in counts or prefix_counts(df, hash_col, prefix):
            if left < n:
                break
            left -= n
        else:
            return None
        prefix, counts = bucket, None
        if n <= 10_000 or len(prefix) >= 30:
            break
    inside = df.where(F.startswith(F.col(hash_col), F.lit(prefix))).select(hash_col)
    return inside.orderBy(hash_col).offset(left).limit(1).first()[0]


def prefix_counts(df: DataFrame, hash_col: str, prefix: str = "") -> list[tuple[str, int]]:
    """Rows per next three digits of the hashes that begin with ``prefix``."""
    bucket = F.substr(F.col(hash_col), F.lit(1), F.lit(len(prefix) + 3))
    inside = df.where(F.startswith(F.col(hash_col), F.lit(prefix))) if prefix else df
    rows = inside.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()
    return sorted((r["b"], r["n"]) for r in rows)


def split_cuts(
    df: DataFrame, key: str = "film", ratios=SPLIT_RATIOS, seed: int = SPLIT_SEED
) -> list[str | None]:
    """Hashes at which the split changes, for a table with one row per key."""
    hashed = df.select(seeded_hash(key, seed=seed).alias("h"))
    counts = prefix_counts(hashed, "h")
    total = sum(n for _, n in counts)
    train = int(total * ratios[0])
    val = int(total * ratios[1])
    return [hash_at_rank(hashed, "h", rank, counts) for rank in (train, train + val)]


def split_of(key, cuts: list[str | None], seed: int = SPLIT_SEED):
    """Split of a key. Needs no join: the two cuts decide it for any table."""
    h = seeded_hash(key, seed=seed)
    first, second = (c if c is not None else "g" for c in cuts)
    return (
        F.when(h < first, SPLITS[0]).when(h < second, SPLITS[1]).otherwise(SPLITS[2])
    )
