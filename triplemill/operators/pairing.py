"""Pair the triples of an entity with its text."""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from triplemill.constants import MIN_TRIPLES
from triplemill.functions.rdf import compact_iri
from triplemill.functions.text import present, strip
from triplemill.operators.keyfilter import KeyFilter
from triplemill.operators.ranking import CHUNK, HOT_ROWS, gather, hot_keys, rank_within
from triplemill.plans.scratch import written

ARRIVAL = ["seq", "p", "o", "s"]
OUTCOMES = ("kept", "no_text", "few_triples")


def compact_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: compact_iri(F.col(n)) for n in names})


def directed(raw: DataFrame) -> DataFrame:
    """``(film, s, p, o, seq)``: incoming edges turned round, all else outgoing."""
    incoming = F.coalesce("dir", F.lit("out")) == "in"
    return raw.select(
        "film",
        F.when(incoming, F.col("o")).otherwise(F.col("film")).alias("s"),
        "p",
        F.when(incoming, F.col("film")).otherwise(F.col("o")).alias("o"),
        "seq",
    )


def distinct_triples(triples: DataFrame) -> DataFrame:
    """Each triple of an entity once, at its first arrival.

    The shuffle is on the whole triple after partial aggregation, so neither a
    large entity nor a triple repeated many times lands in one task.
    """
    return triples.groupBy("film", "s", "p", "o").agg(F.min("seq").alias("seq"))


def last_texts(texts: DataFrame) -> DataFrame:
    """Last non-empty text of each entity, stripped; blank ones drop out after."""
    return (
        texts.where(present(F.col("text")))
        .groupBy("film")
        .agg(F.max_by("text", F.struct("seq", "text")).alias("text"))
        .withColumn("text", strip(F.col("text")))
        .where("text <> ''")
    )


def pair_flags(
    triples: DataFrame, texts: DataFrame, min_triples=MIN_TRIPLES, deduplicate=True
) -> DataFrame:
    """One row per entity that has triples: count, text and what becomes of it."""
    sizes = (
        (distinct_triples(triples) if deduplicate else triples)
        .groupBy("film")
        .agg(F.count("*").cast("int").alias("n_triples"))
    )
    return sizes.join(last_texts(texts), "film", "left").withColumn(
        "outcome",
        F.when(F.col("text").isNull(), "no_text")
        .when(F.col("n_triples") < min_triples, "few_triples")
        .otherwise("kept"),
    )


def pairing_audit(flags: DataFrame) -> DataFrame:
    """Entities kept, dropped without text, and dropped with too few triples."""
    return flags.agg(*(F.count_if(F.col("outcome") == name).alias(name) for name in OUTCOMES))


def kept_triples(triples: DataFrame, flags: DataFrame) -> DataFrame:
    """Long form of the pairs: the distinct triples of the kept entities."""
    kept = flags.where("outcome = 'kept'").select("film", "n_triples")
    return distinct_triples(triples).join(kept, "film")


def triples_by_film(
    triples: DataFrame, hot_rows: int = HOT_ROWS, chunk: int = CHUNK, deduplicate=True
) -> DataFrame:
    """``(film, items)`` with the triples of an entity in arrival order.

    One shuffle on the entity serves the de-duplication, the collection and a
    later join by entity. Entities too large for that go another way.
    """
    return _by_film(triples, hot_keys(triples, ["film"], hot_rows), chunk, deduplicate)


def _by_film(triples: DataFrame, hot: DataFrame | None, chunk: int, deduplicate: bool) -> DataFrame:
    if hot is None:
        rows = triples.repartition("film")
        if deduplicate:
            rows = distinct_triples(rows)
        return gather(rows, ["film"], ARRIVAL, ARRIVAL, None, chunk)
    rows = distinct_triples(triples) if deduplicate else triples
    return gather(rows, ["film"], ARRIVAL, ARRIVAL, hot, chunk)


class Wanted(NamedTuple):
    """Triples of entities that may have a text, those of their entities that are
    hot or long (None if there are none), and how many entities are left out (None
    if that was not asked for)."""

    rows: DataFrame
    hot: DataFrame | None
    left_out: int | None
    long: DataFrame | None


def wanted_triples(
    triples: DataFrame,
    texts: DataFrame,
    hot_rows: int = HOT_ROWS,
    long_rows: int | None = None,
    audit: bool = True,
) -> Wanted:
    """Hold back the triples of entities without a text.

    A filter of the texts' keys is broadcast, so triples without a text are neither
    shuffled nor collected. One pass over the entity column, added up before its
    shuffle, finds the entities that are hot, or too long for one row, and, for an
    ``audit``, counts those without a text; without it, these are passed over.
    """
    keys = KeyFilter(texts.select("film"), "film")
    if audit:
        marked = keys.marked(triples, "film", "_may")
        rows = marked.where("_may").drop("_may")
    else:
        rows = keys.kept(triples, "film")
        marked = rows.withColumn("_may", F.lit(True))
    sizes = marked.groupBy("film").agg(F.count("*").alias("_n"), F.max("_may").alias("_may"))
    found = sizes.agg(
        F.max(F.when(F.col("_may"), F.col("_n"))).alias("most"),
        F.count_if(~F.col("_may")).alias("left_out"),
    ).first()

    def beyond(rows: int | None) -> DataFrame | None:
        if rows is None or (found["most"] or 0) <= rows:
            return None
        return written(sizes.where(F.col("_may") & (F.col("_n") > rows)).select("film"))

    left_out = found["left_out"] if audit else None
    return Wanted(rows, beyond(hot_rows), left_out, beyond(long_rows))


def _records(rows: DataFrame) -> DataFrame:
    return rows.select(
        "film",
        "text",
        F.transform(
            "items",
            lambda t: F.struct(t["s"].alias("s"), t["p"].alias("p"), t["o"].alias("o")),
        ).alias("triples"),
        F.size("items").alias("n_triples"),
    )


def pair_records(
    triples: DataFrame,
    texts: DataFrame,
    min_triples: int = MIN_TRIPLES,
    hot_rows: int = HOT_ROWS,
    chunk: int = CHUNK,
    deduplicate: bool = True,
) -> DataFrame:
    """Canonical pairs: ``film, text, triples, n_triples``."""
    wanted = wanted_triples(triples, texts, hot_rows, audit=False)
    grouped = _by_film(wanted.rows, wanted.hot, chunk, deduplicate).where(
        F.size("items") >= min_triples
    )
    return _records(grouped.join(last_texts(texts), "film"))


class Audited(NamedTuple):
    """Pairs, a function that gives the audit once they have been written, and the
    triples of the entities kept that are too long for one row (None if there are
    none), with ``text`` and ``n_triples``."""

    pairs: DataFrame
    audit: Callable[[], DataFrame]
    long: DataFrame | None


def audited_records(
    triples: DataFrame,
    texts: DataFrame,
    min_triples: int = MIN_TRIPLES,
    hot_rows: int = HOT_ROWS,
    chunk: int = CHUNK,
    deduplicate: bool = True,
    long_rows: int | None = None,
) -> Audited:
    """The same pairs, with the audit of the pairing. Entities with more than
    ``long_rows`` triples stay in long form.

    The outcomes are observed in the very rows that are written, in the tasks of
    the writing stage, each of which counts once; the triples are not read, shuffled
    or de-duplicated for them again.
    """
    wanted = wanted_triples(triples, texts, hot_rows, long_rows)
    rows, long, flags = wanted.rows, None, None
    if wanted.long is not None:
        apart = rows.join(wanted.long, "film", "left_semi")
        apart = written(distinct_triples(apart) if deduplicate else apart)
        flags = written(pair_flags(apart, texts, min_triples, deduplicate=False))
        kept = flags.where("outcome = 'kept'").select("film", "text", "n_triples")
        long = apart.join(kept, "film")
        rows = rows.join(wanted.long, "film", "left_anti")
    outcome = (
        F.when(F.col("text").isNull(), "no_text")
        .when(F.size("items") < min_triples, "few_triples")
        .otherwise("kept")
    )
    seen = Observation()
    every = (
        _by_film(rows, wanted.hot, chunk, deduplicate)
        .join(last_texts(texts), "film", "left")
        .withColumn("outcome", outcome)
        .observe(seen, *(F.count_if(F.col("outcome") == name).alias(name) for name in OUTCOMES))
    )

    def audit() -> DataFrame:
        counts = dict(seen.get)
        counts["no_text"] += wanted.left_out
        if flags is not None:
            of_long = pairing_audit(flags).first()
            counts = {name: counts[name] + of_long[name] for name in OUTCOMES}
        schema = ", ".join(f"{name} bigint" for name in OUTCOMES)
        return triples.sparkSession.createDataFrame([[counts[name] for name in OUTCOMES]], schema)

    return Audited(_records(every.where("outcome = 'kept'")), audit, long)


def pair_parts(long: DataFrame, part_rows: int) -> DataFrame:
    """Pairs of long entities in parts: ``film, part, text, triples, n_triples``.

    A part has ``part_rows`` triples in arrival order; the first one has the text,
    and each the number of triples of the whole entity.
    """
    ranked = rank_within(long, ["film"], ARRIVAL, "_rank").withColumn(
        "part", F.floor((F.col("_rank") - 1) / part_rows).cast("bigint")
    )
    item = F.struct("_rank", "s", "p", "o")
    return (
        ranked.groupBy("film", "part")
        .agg(
            F.max(F.when(F.col("part") == 0, F.col("text"))).alias("text"),
            F.sort_array(F.collect_list(item)).alias("items"),
            F.max("n_triples").cast("int").alias("n_triples"),
        )
        .select(
            "film",
            "part",
            "text",
            F.transform(
                "items", lambda t: F.struct(t["s"].alias("s"), t["p"].alias("p"), t["o"].alias("o"))
            ).alias("triples"),
            "n_triples",
        )
    )
