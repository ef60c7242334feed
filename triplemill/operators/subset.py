"""A small subset spread evenly over splits and entity sizes."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triplemill import constants as C
from triplemill.functions.text import present
from triplemill.operators.ranking import Ranges
from triplemill.plans.scratch import written

SUBSET_SIZE = 20
HELD_OUT_MIN = 4


def pair_index(pairs: DataFrame) -> DataFrame:
    """Last record of each entity; records without an entity are skipped."""
    rest = [c for c in pairs.columns if c not in ("film", "seq")]
    return (
        pairs.where(present(F.col("film")))
        .groupBy("film")
        .agg(F.max(F.struct("seq", *rest)).alias("last"))
        .select("film", "last.*")
        .drop("seq")
    )


def split_sizes(index: DataFrame) -> DataFrame:
    """Entities per split; a split without any is there with 0."""
    spark = index.sparkSession
    grid = spark.createDataFrame([(s,) for s in C.SPLITS], "split string")
    counted = index.groupBy("split").agg(F.count("*").alias("size"))
    return grid.join(counted, "split", "left").select(
        "split", F.coalesce("size", F.lit(0)).cast("bigint").alias("size")
    )


def allocate(sizes: DataFrame, total: int) -> DataFrame:
    """Share ``total`` over the (three) splits by their size.

    Whole parts first, a non-empty split gets at least one if the total
    allows; then one more or one less each in the order of what is left over.
    """
    every = Window.partitionBy(F.lit(0))
    basis = sizes.withColumns(
        {"films": F.sum("size").over(every), "filled": F.count_if(F.col("size") > 0).over(every)}
    ).withColumn("total", F.least(F.lit(total), F.col("films")))
    exact = F.col("total") * F.col("size") / F.nullif("films", F.lit(0))
    floor = F.floor(exact)
    base = F.when(F.col("total") >= F.col("filled"), F.greatest(floor, F.lit(1))).otherwise(floor)
    shared = basis.select(
        "split",
        "size",
        "total",
        F.when(F.col("size") > 0, F.least("size", base)).otherwise(0).alias("base"),
        exact.alias("exact"),
    ).withColumns(
        {
            "left": F.col("exact") - F.col("base"),
            "diff": F.col("total") - F.sum("base").over(every),
        }
    )
    can = F.when(F.col("diff") > 0, (F.col("size") > F.col("base")).cast("int")).otherwise(
        (F.col("base") > 0).cast("int")
    ) * (F.col("size") > 0).cast("int")
    upwards = Window.partitionBy(F.lit(0)).orderBy(F.desc("can"), F.desc("left"), F.desc("split"))
    downwards = Window.partitionBy(F.lit(0)).orderBy(F.desc("can"), "left", "split")
    place = F.when(F.col("diff") > 0, F.row_number().over(upwards)).otherwise(
        F.row_number().over(downwards)
    )
    one = (F.col("can") * (F.col("place") <= F.abs("diff")).cast("int")) * F.signum("diff")
    return (
        shared.withColumn("can", can)
        .withColumn("place", place)
        .select("split", "size", (F.col("base") + one).cast("bigint").alias("take"))
    )


def rebalance(shares: dict[str, int], sizes: dict[str, int], total: int) -> dict[str, int]:
    """Raise val and test to their minimum from the other splits, in split
    order; train keeps one. Left as it is when the total is too small."""
    out = dict(shares)
    floors = {s: min(HELD_OUT_MIN, sizes[s]) for s in ("val", "test")}
    keep = {"train": min(1, sizes["train"]), "val": 0, "test": 0}
    if total < keep["train"] + sum(floors.values()):
        return out
    out["train"] = max(out["train"], keep["train"])
    for split, floor in floors.items():
        for donor in (s for s in C.SPLITS if s != split):
            moved = max(0, min(floor - out[split], out[donor] - keep[donor]))
            out[donor] -= moved
            out[split] += moved
    return out


def subset_shares(sizes: DataFrame, total: int) -> dict[str, int]:
    """Final number of entities per split (three numbers)."""
    rows = allocate(sizes, total).collect()
    size = {r["split"]: r["size"] for r in rows}
    films = sum(size.values())
    if films == 0:
        raise ValueError("no entities to choose from")
    shares = rebalance({r["split"]: r["take"] for r in rows}, size, min(total, films))
    return {s: min(size[s], n) for s, n in shares.items()}


def by_size(index: DataFrame) -> DataFrame:
    """Sort keys of an entity: its number of triples (0 if missing), its name."""
    return index.withColumns(
        {
            "n_triples": F.coalesce("n_triples", F.lit(0)),
            "film": F.coalesce("film", F.lit("")),
        }
    )


def spaced(total: int, k: int) -> list[int]:
    """Ranks (from 1) of ``k`` evenly spaced rows of ``total``."""
    if total <= k:
        return list(range(1, total + 1))
    if k == 1:
        return [total // 2 + 1]
    return [round(i * (total - 1) / (k - 1)) + 1 for i in range(k)]


def evenly_spaced(index: DataFrame, shares: dict[str, int]) -> DataFrame:
    """Pick the given number per split, evenly along ``(n_triples, film)``.

    Only ranges that hold a pick are sorted, and nothing but their keys is moved.
    The keys are written once, since they are read for the counts and for the picks.
    """
    rows = by_size(index).select("split", "film", "n_triples")
    wanted = rows.where(F.col("split").isin(*(s for s, k in shares.items() if k > 0)))
    ranges = Ranges(written(wanted), ["split"], ["n_triples", "film"])
    totals = {key: sum(n for *_, n in sizes) for key, sizes in ranges.sizes.items()}
    picks = ranges.at({key: spaced(n, shares[key[0]]) for key, n in totals.items()}, "_rank")
    return picks.select("split", "film", "n_triples")


def select_subset(index: DataFrame, total: int = SUBSET_SIZE) -> DataFrame:
    """Subset ``(split, film, n_triples)`` of about ``total`` entities."""
    return evenly_spaced(index, subset_shares(split_sizes(index), total))


def subset_examples(examples: DataFrame, chosen: DataFrame) -> DataFrame:
    """Examples of the chosen entities, in their own split only."""
    return examples.join(chosen.select("film", "split"), ["film", "split"], "left_semi")


def subset_counts(examples: DataFrame, tasks=C.TASKS) -> DataFrame:
    """Examples per task and split; combinations without any count 0."""
    grid = examples.sparkSession.createDataFrame(
        [(t, s) for t in tasks for s in C.SPLITS], "task string, split string"
    )
    counted = examples.groupBy("task", "split").agg(F.count("*").alias("n"))
    return grid.join(counted, ["task", "split"], "left").select(
        "task", "split", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def manifest_json(chosen: DataFrame, counts: DataFrame, source: str) -> DataFrame:
    """Manifest of a subset as one JSON text, as long as the subset; a split
    without entities has an empty list."""
    grid = chosen.sparkSession.createDataFrame([(s,) for s in C.SPLITS], "split string")
    films = (
        grid.join(chosen, "split", "left")
        .groupBy("split")
        .agg(F.sort_array(F.collect_list("film")).alias("films"))
    )
    per_split = films.agg(
        F.map_from_arrays(F.collect_list("split"), F.collect_list("films")).alias("per_split"),
        F.sum(F.size("films")).alias("total_films"),
        F.lit(0).alias("one"),
    )
    tasks = (
        counts.groupBy("task")
        .agg(F.map_from_arrays(F.collect_list("split"), F.collect_list("n")).alias("n"))
        .agg(
            F.map_from_arrays(F.collect_list("task"), F.collect_list("n")).alias("tasks"),
            F.lit(0).alias("one"),
        )
    )
    return per_split.join(tasks, "one").select(
        F.to_json(
            F.struct(
                "total_films", "per_split", "tasks", F.lit(source).alias("source_processed_dir")
            )
        ).alias("manifest")
    )
