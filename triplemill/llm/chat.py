"""Conversations as text, of which logged snapshots are collapsed first.

Native: DataFrame functions only. A log that is saved again after every turn has
a conversation many times, each time longer. Every turn gets a hash of all turns
up to it: the sums of three 40-bit pieces of a SHA-256 of place, role and text.
A conversation whose last hash is also the hash of an earlier turn of another is
a prefix of it; an anti-join keeps the others, of equal ones that with the least
id. Only those are written out, in the form ``<|im_start|>role``, the text and
``<|im_end|>`` for each turn.

Both sides of the anti-join are reduced to one row per hash before, so a first
turn, or a whole conversation, that is very frequent is one row there. A
conversation is one row of the result and is held as such by one task.

Turns are sorted by number, then role, then text, nulls first; rows that are
repeated as a whole count once; turns with one number and different texts all
stay. A null role is written ``unknown``, a null text as an empty one (but neither
is taken as equal to these). Turns without an id are one conversation. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplemill.llm.common import tag

LANES = ("h0", "h1", "h2")


def hashes(place: Column, role: Column, text: Column) -> list[Column]:
    whole = F.sha2(F.concat_ws("/", place.cast("string"), F.sha2(tag(role), 256), tag(text)), 256)
    return [
        F.conv(F.substring(whole, 1 + 10 * i, 10), 16, 10).cast("bigint").alias(lane)
        for i, lane in enumerate(LANES)
    ]


def with_prefix_hashes(turns: DataFrame) -> DataFrame:
    """Turns with their place, the number of turns, and the hash up to them."""
    own = Window.partitionBy("conv")
    order = own.orderBy("turn", "role", "text")
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = turns.withColumn("k", F.row_number().over(order)).withColumn(
        "n", F.count("*").over(own)
    )
    hashed = placed.select("*", *hashes(F.col("k"), F.col("role"), F.col("text")))
    return hashed.withColumns({lane: F.sum(lane).over(up_to) for lane in LANES})


def collapsed(
    conversations: DataFrame, key="conv_id", turn="turn", role="role", text="text"
) -> DataFrame:
    """One row per maximal conversation: key, n_turns, n_copies, formatted."""
    turns = conversations.select(
        F.col(key).alias("conv"),
        F.col(turn).alias("turn"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
    ).distinct()
    hashed = with_prefix_hashes(turns)
    ends = (
        hashed.where("k = n")
        .groupBy("n", *LANES)
        .agg(
            F.min(F.struct(F.col("conv").isNull(), "conv"))["conv"].alias("kept"),
            F.count("*").alias("copies"),
        )
    )
    starts = hashed.where("k < n").select(F.col("k").alias("n"), *LANES).distinct()
    whole = ends.join(starts, ["n", *LANES], "left_anti").select(
        "kept", "copies", F.col("n").alias("n_turns")
    )
    line = F.concat(
        F.lit("<|im_start|>"),
        F.coalesce("role", F.lit("unknown")),
        F.lit("\n"),
        F.coalesce("text", F.lit("")),
        F.lit("<|im_end|>\n"),
    )
    gathered = turns.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))).alias("all")
    )
    return gathered.join(whole, F.col("conv").eqNullSafe(F.col("kept"))).select(
        F.col("conv").alias(key),
        F.col("n_turns").cast("bigint").alias("n_turns"),
        F.col("copies").alias("n_copies"),
        F.array_join(F.col("all")["line"], "").alias("formatted"),
    )


SQL = """
with t as (select distinct conv_id, turn, role, text from conversations),
r as (select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k,
  count(*) over (partition by conv_id) as n,
  '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) as line from t),
p as (select conv_id, k, n, string_agg(line, '') over (partition by conv_id order by k) as up_to from r),
e as (select n, up_to, min(conv_id) as conv_id, count(*) as copies from p where k = n group by n, up_to)
select conv_id, n as n_turns, copies as n_copies, up_to as formatted from e
where not exists (select 1 from p where p.k < p.n and p.k = e.n and p.up_to = e.up_to)
"""
