"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplemill.llm.common import look_up
from triplemill.plans.scratch import written


def _star(pairs: DataFrame, whole: bool) -> DataFrame:
    """Neighbours ``v`` of each ``u`` linked to the least of them and ``u``."""
    least = written(
        pairs.groupBy("u").agg(
            F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")
        )
    )
    found = look_up(pairs, least, "u", "n")
    if whole:  # large star: neighbours above u
        out = found.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:  # small star: neighbours below u, and u itself
        out = found.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``links (a, b)``: the root is the least
    node of the component. Links of a node with itself are left out.

    Links stay a table that is rewritten each round; only its number of rows and
    a checksum come to the driver. A node with very many links is looked up apart.
    """
    now = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = written(_star(both, True))
        down = large.select(
            F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
        ).distinct()
        now = written(_star(down, False))
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if new == state or not new[0]:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
