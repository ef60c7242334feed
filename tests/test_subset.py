"""Shares of the splits and even picks."""

import random

import pytest
from pyspark.sql import functions as F

from triplemill.constants import SPLITS
from triplemill.operators import ranking, subset


def sizes_of(spark, sizes):
    return spark.createDataFrame(list(zip(SPLITS, sizes)), "split string, size bigint")


def test_twenty_of_many(spark):
    assert subset.subset_shares(sizes_of(spark, (800, 100, 100)), 20) == {"train": 12, "val": 4, "test": 4}


@pytest.mark.parametrize(
    "sizes, total, want",
    [
        ((0, 0, 9), 5, (0, 0, 5)),
        ((0, 0, 3), 20, (0, 0, 3)),
        ((100, 1, 1), 2, (2, 0, 0)),
        ((100, 10, 10), 9, (1, 4, 4)),
        ((100, 10, 10), 8, (6, 1, 1)),
        ((1, 50, 50), 20, (1, 10, 9)),
        ((2, 2, 2), 100, (2, 2, 2)),
    ],
)
def test_shares(spark, sizes, total, want):
    got = subset.subset_shares(sizes_of(spark, sizes), total)
    assert tuple(got[s] for s in SPLITS) == want


def test_shares_by_chance(spark):
    """What must hold of any shares, whatever the way they are found."""
    rng = random.Random(9)
    for _ in range(12):
        sizes = [rng.choice([0, 1, 2, 5, 30, 300]) for _ in SPLITS]
        total = rng.randint(1, 40)
        if not sum(sizes):
            continue
        got = subset.subset_shares(sizes_of(spark, sizes), total)
        assert all(0 <= got[s] <= n for s, n in zip(SPLITS, sizes)), (sizes, total)
        # train may get its one entity on top
        assert sum(got.values()) - min(total, sum(sizes)) in (0, 1)
        if total >= 12:
            least = {s: min(n, 1 if s == "train" else 4) for s, n in zip(SPLITS, sizes)}
            assert all(got[s] >= least[s] for s in SPLITS), (sizes, total)


def test_no_entities(spark):
    with pytest.raises(ValueError):
        subset.subset_shares(sizes_of(spark, (0, 0, 0)), 5)


def test_minimum_may_take_from_the_other_held_out_split():
    size = {"train": 1, "val": 50, "test": 50}
    assert subset.rebalance({"train": 1, "val": 1, "test": 9}, size, 11) == {"train": 1, "val": 4, "test": 6}


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 10, 11, 12])
def test_even_picks(spark, k):
    index = spark.range(11).select(
        F.lit("train").alias("split"),
        F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("film"),
        F.floor(((F.col("id") * 7) % 11) / 2).cast("int").alias("n_triples"),
    )
    order = sorted((r["n_triples"], r["film"]) for r in index.collect())
    got = subset.evenly_spaced(index, {"train": k, "val": 0, "test": 0})
    got = sorted((r["n_triples"], r["film"]) for r in got.collect())
    if k == 1:
        want = [order[5]]
    else:
        want = [order[round(i * 10 / (k - 1))] for i in range(k)] if 0 < k < 11 else order[: k]
    assert got == want


def test_index_keeps_the_last_record(spark):
    df = spark.createDataFrame(
        [("a", 0, 3, "train"), ("a", 1, 5, "train"), (None, 2, 1, "val"), ("", 3, 1, "val")],
        "film string, seq int, n_triples int, split string",
    )
    assert [tuple(r) for r in subset.pair_index(df).collect()] == [("a", 5, "train")]


@pytest.mark.parametrize("range_rows", [10**6, 400, 7])
def test_ranks_are_found_without_sorting_all(spark, range_rows):
    """Rows at given ranks, and first rows, are those of a window over everything."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 10 < 9, "b").alias("k"),
        (F.hash("id") % 5).alias("x"),
        F.when(F.col("id") % 11 > 0, F.concat(F.lit("f"), "id")).alias("y"),
    )
    ranked = df.withColumn("r", F.expr("row_number() over (partition by k order by x, y)")).collect()
    by_rank = {(r["k"], r["r"]): (r["x"], r["y"]) for r in ranked}
    ranges = ranking.Ranges(df, ["k"], ["x", "y"], range_rows)
    wanted = {("a",): [1, 900, 1800], ("b",): [900, 5, 901], (None,): [7], ("z",): [1]}
    got = {(r["k"], r["r"]): (r["x"], r["y"]) for r in ranges.at(wanted, "r").where("k is not null").collect()}
    keys = {(k[0], r) for k, some in wanted.items() for r in some if k[0] and (k[0], r) in by_rank}
    assert got.keys() == keys and all(got[k] == by_rank[k] for k in keys)
    first = ranges.first(450, "r").collect()
    assert {(r["k"], r["r"]) for r in first} == {k for k in by_rank if k[1] <= 450}
    assert all((r["x"], r["y"]) == by_rank[r["k"], r["r"]] for r in first)


def test_only_ranges_with_a_pick_are_sorted(spark):
    df = spark.range(20_000).select(F.lit("a").alias("k"), F.col("id").alias("x"))
    ranges = ranking.Ranges(df, ["k"], ["x"], 100)
    parts = ranges.sizes[("a",)]
    assert len(parts) > 100 and sum(n for *_, n in parts) == 20_000
    got = ranges.at({("a",): [1, 10_000, 20_000]})
    assert sorted(r["x"] for r in got.collect()) == [0, 9_999, 19_999]
    low = ranges.first(150)
    assert "SinglePartition" not in low._jdf.queryExecution().executedPlan().toString()
    assert low.count() == 150


def test_ranks_of_an_empty_table(spark):
    none = spark.range(0).select(F.lit("a").alias("k"), "id")
    assert ranking.Ranges(none, ["k"], ["id"]).at({("a",): [1]}).count() == 0
    assert ranking.Ranges(none, ["k"], ["id"]).first(3).count() == 0


def test_even_spacing():
    assert subset.spaced(3, 5) == [1, 2, 3] and subset.spaced(9, 1) == [5] and subset.spaced(0, 2) == []
    assert subset.spaced(11, 3) == [1, 6, 11] and subset.spaced(10, 4) == [1, 4, 7, 10]
    assert subset.spaced(6, 3) == [1, 3, 6]
