"""Mixing sources to target weights by a splitting tree of block quotas.

Targets: the sources, in order, weigh 3, 1, 2, 3, 1, 2 ..., and share a number of
words by weight; no source gives more than ``MOST`` times its size, and what is
above goes to the others by weight.

A source's documents are cut into blocks of ``BLOCK`` words, and its blocks are
put into an order given by a seeded hash. As many whole rounds through the
blocks as fit into the target are taken, and then the first blocks of a further
round until the target is reached; the last one is cut. That fixes each source's
quota of blocks exactly. A tree then deals the quotas out to the output shards:
at each node the shards on the left get their share of the node's blocks, by
source as drawn without replacement (multivariate hypergeometric), the right the
rest, until each leaf holds one shard's quotas. A shard takes the next blocks of
each source's order, so shards are disjoint, and sorts its own by another hash.

The top of the tree works on the list of sources in one task, which is as long as
the catalogue of sources and not as the data; its parts go on in tasks of their
own. Ranks within a source are made across range partitions, so a source that
holds most rows is dealt over many tasks. Draws come from generators seeded by
the node, so reruns agree.

A null text has size 0, and nothing is taken of it; a null source is the last
source; every row is a document of its own, also those without an id or with one
that others have, which are told apart by their text and, where that is the same,
by number; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplemill.llm.common import blocks as text_blocks
from triplemill.llm.common import n_words, running, tag, word_spans
from triplemill.plans.scratch import written

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MOST = 2
BLOCK = 256
SHARD_WORDS = 1 << 20
SEED = 17
# Shards below a node that is worked on by a task of its own.
SUBTREE = 512
# Places of a source's order that are looked up together.
CELL = 64
# Numpy draws hypergeometric numbers from fewer than so many of a kind.
NUMPY_MOST = 10**9
# Standard deviations from the mean beyond which probabilities are below 1e-30.
SPREAD = 12


# --- sizes and targets --------------------------------------------------------


# What tells the rows of a document table apart.
DOC = ("doc", "mark", "copy")


def marked(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sizes(docs: DataFrame, key="doc_id", text="text", source="source") -> DataFrame:
    """One row per document: id, mark of the text, number among equal ones, source,
    size."""
    rows = docs.select(
        F.col(key).alias("doc"),
        F.col(source).alias("source"),
        marked(F.col(text)).alias("mark"),
        n_words(F.col(text)).alias("size"),
    )
    copies = rows.groupBy("doc", "mark", "source", "size").agg(F.count("*").alias("n"))
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")


def targets(base: DataFrame, weights=WEIGHTS, total=TOTAL, most=MOST) -> DataFrame:
    """One row per source: its size and target.

    A source is full if the level at which all still open sources would get
    ``level * weight`` is above its limit. Taken in the order of limit / weight,
    the first source that is not full fixes the level for itself and the rest.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    per_source = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = per_source.withColumn(
        "weight",
        F.element_at(
            F.array(*[F.lit(w) for w in weights]),
            ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int"),
        ),
    ).withColumn("most", F.col("source_size") * most)
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    sum_before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    left = F.sum("source_size").over(whole) * total - sum_before("most")
    leveled = weighed.withColumn("level", left / (F.sum("weight").over(whole) - sum_before("weight")))
    open_ = F.col("level") * F.col("weight") <= F.col("most")
    level = F.min(F.when(open_, F.struct(F.col("most") / F.col("weight"), "level"))).over(whole)["level"]
    return leveled.select(
        "source",
        "source_size",
        F.least(F.col("most").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight")).alias("target"),
    )


# --- the tree -----------------------------------------------------------------


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``good`` are among ``n`` drawn from ``good + bad`` without
    replacement, for numbers of any size.

    Beyond numpy's range the number is found by inversion: neighbouring
    probabilities have a simple ratio, so they follow from the most likely number
    up and down, as far as they count at all.
    """
    if not good or not n:
        return 0
    if not bad:
        return n
    if max(good, bad) < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, n))
    whole = good + bad
    mean = n * good / whole
    reach = SPREAD * (mean * (bad / whole) * ((whole - n) / max(1, whole - 1))) ** 0.5 + SPREAD
    low, high = max(0, n - bad, int(mean - reach)), min(good, n, int(mean + reach) + 1)
    middle = min(max((n + 1) * (good + 1) // (whole + 2), low), high)
    up = np.arange(middle, high, dtype=np.float64)
    down = np.arange(middle, low, -1, dtype=np.float64)
    above = np.cumprod((good - up) / (up + 1) * ((n - up) / (bad - n + up + 1)))
    below = np.cumprod(down / (good - down + 1) * ((bad - n + down) / (n - down + 1)))
    total = np.cumsum(np.concatenate([below[::-1], [1.0], above]))
    return low + int(np.searchsorted(total, rng.random() * total[-1], side="right"))


def draw(rng: np.random.Generator, colours: np.ndarray, n: int) -> np.ndarray:
    """How many of each colour are among ``n`` drawn without replacement."""
    out, left, rest = np.zeros_like(colours), n, int(colours.sum())
    for i, good in enumerate(map(int, colours)):
        if not left:
            break
        out[i] = hypergeometric(rng, good, rest - good, left)
        left, rest = left - int(out[i]), rest - good
    return out


def grow(quotas: np.ndarray, low: int, high: int, seed: int, stop: int) -> Iterator[tuple]:
    """Nodes of at most ``stop`` shards below the node ``low .. high``."""
    todo = [(low, high, quotas)]
    while todo:
        low, high, quotas = todo.pop()
        if high - low <= stop:
            yield low, high, quotas
            continue
        middle = (low + high) // 2
        n = int(quotas.sum()) * (middle - low) // (high - low)
        left = draw(np.random.default_rng([seed, low, high]), quotas, n)
        todo.append((middle, high, quotas - left))
        todo.append((low, middle, left))


NODES = "sid string, low bigint, high bigint, quota bigint"


def grown(nodes: DataFrame, seed: int, stop: int) -> DataFrame:
    def expand(group: pa.Table) -> pa.Table:
        group = group.sort_by("sid")
        ids, quotas = group.column("sid"), group.column("quota").to_numpy()
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        found = [
            pa.table(
                [ids, pa.array(np.full(len(q), a)), pa.array(np.full(len(q), b)), pa.array(q)],
                names=["sid", "low", "high", "quota"],
            )
            for a, b, q in grow(quotas, low, high, seed, stop)
        ]
        return pa.concat_tables(found)

    return nodes.groupBy("low", "high").applyInArrow(expand, NODES)


def shard_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``sid, shard, quota`` from ``sid, quota``."""
    root = quotas.select("sid", F.lit(0).cast("bigint").alias("low"), F.lit(shards).cast("bigint").alias("high"), "quota")
    leaves = grown(grown(root, seed, SUBTREE), seed, 1)
    return leaves.select("sid", F.col("low").alias("shard"), "quota")


# --- blocks -------------------------------------------------------------------


def block_table(base: DataFrame, block: int = BLOCK) -> DataFrame:
    count = F.ceil(F.col("size") / block).cast("bigint")
    return base.where("size > 0").select(
        "sid", *DOC, "size", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("block")
    ).select(
        "sid", *DOC, "block", F.least(F.lit(block), F.col("size") - F.col("block") * block).alias("words")
    )


def mixture(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=WEIGHTS,
    total: float = TOTAL,
    most: float = MOST,
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """The documents with source_size and target, and the mix: one row per block
    taken, with its round, words, shard and place in the shard."""
    base = written(sizes(docs, key, text, source).withColumn("sid", tag(F.col("source"))))
    goal = written(targets(base, weights, total, most).withColumn("sid", tag(F.col("source"))))
    whole = goal.select(
        "sid", "source_size", F.round("target").cast("bigint").alias("take")
    ).where("take > 0")
    whole = whole.withColumn("rounds", F.floor(F.col("take") / F.col("source_size")).cast("bigint"))
    whole = whole.withColumn("rest", F.col("take") - F.col("rounds") * F.col("source_size"))
    cut = block_table(base, block).withColumn("h", F.xxhash64(F.lit(seed), "doc", "block"))
    ordered = running(cut, ["sid"], ["h", *DOC, "block"], "words").drop("h")
    ordered = ordered.join(whole.select("sid", "rounds", "rest"), "sid")
    last = F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before"))).cast("bigint")
    ordered = written(ordered.withColumn("last", last).drop("before", "rest"))
    quotas = written(
        ordered.groupBy("sid").agg(
            F.count("*").alias("m"),
            (F.sum("rounds") + F.count(F.when(F.col("last") > 0, 1))).alias("quota"),
        )
    )
    words = whole.agg(F.sum("take")).first()[0] or 0
    dealt = shard_quotas(quotas.select("sid", "quota"), max(1, -(-words // shard_words)), seed)
    so_far = Window.partitionBy("sid").orderBy("shard")
    ranges = (
        dealt.where("quota > 0")
        .withColumn("end", F.sum("quota").over(so_far))
        .withColumn("begin", F.col("end") - F.col("quota"))
        .withColumn(
            "cell",
            F.explode(
                F.sequence(
                    F.floor(F.col("begin") / CELL), F.floor((F.col("end") - 1) / CELL)
                )
            ),
        )
        .select("sid", "cell", "shard", "begin", "end")
    )
    taken = ordered.select(
        "sid",
        *DOC,
        "block",
        "rank",
        F.explode(
            F.concat(
                F.transform(
                    F.array_repeat(F.col("words"), F.col("rounds").cast("int")),
                    lambda n, i: F.struct(i.alias("round"), n.cast("bigint").alias("words")),
                ),
                F.when(
                    F.col("last") > 0,
                    F.array(F.struct(F.col("rounds").cast("int").alias("round"), F.col("last").alias("words"))),
                ).otherwise(F.array().cast("array<struct<round:int,words:bigint>>")),
            )
        ).alias("t"),
    ).select("sid", *DOC, "block", "rank", "t.round", "t.words")
    placed = (
        taken.join(quotas.select("sid", "m"), "sid")
        .withColumn("index", F.col("round") * F.col("m") + F.col("rank"))
        .withColumn("cell", F.floor(F.col("index") / CELL))
        .join(ranges, ["sid", "cell"])
        .where("index >= begin and index < end")
    )
    shuffled = Window.partitionBy("shard").orderBy(
        F.xxhash64(F.lit(seed + 1), "sid", "index"), "sid", "index"
    )
    mix = placed.withColumn("place", F.row_number().over(shuffled)).select(
        "shard", "place", "sid", *DOC, "block", "round", "words"
    )
    return base.join(goal.drop("source"), "sid"), mix


def of_same(*names: str) -> Column:
    """Condition that the columns agree with those named ``its_...``, null with null."""
    out = F.lit(True)
    for name in names:
        out = out & F.col(name).eqNullSafe(F.col(f"its_{name}"))
    return out


def taken_words(docs: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """One row per document: key, size, source_size, target, taken, and ``shards``,
    how many of the words taken each shard has."""
    base, mix = mixture(docs, key, **settings)
    own = ["sid", *DOC]
    sums = (
        mix.groupBy(*own, "shard")
        .agg(F.sum("words").cast("bigint").alias("words"))
        .groupBy(*own)
        .agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "words"))).alias("shards"))
        .withColumnsRenamed({c: f"its_{c}" for c in own})
    )
    return base.join(sums, of_same(*own), "left").select(
        F.col("doc").alias(key),
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
        F.coalesce("shards", F.array().cast("array<struct<shard:bigint,words:bigint>>")).alias("shards"),
    )


def mixed_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, **settings
) -> DataFrame:
    """The mix with its texts: shard, place, key, source, block, round, words,
    text (from the block's first word to its last, as it stands in the document)."""
    base, mix = mixture(docs, key, text, source, block=block, **settings)
    wanted = mix.groupBy("sid", "doc", "mark").agg(
        F.collect_list(F.struct("shard", "place", "block", "round", "words")).alias("wanted")
    )
    own = docs.select(
        tag(F.col(source)).alias("its_sid"),
        F.col(key).alias("its_doc"),
        marked(F.col(text)).alias("its_mark"),
        F.col(source).alias("source"),
        F.col(text).alias("text"),
    )
    if base.where("copy > 1").count():
        # Equal rows are one text, of which all their blocks are cut.
        own = own.groupBy("its_sid", "its_doc", "its_mark").agg(
            F.first("source").alias("source"), F.first("text").alias("text")
        )
    joined = own.join(wanted, of_same("sid", "doc", "mark")).select("doc", "source", "text", "wanted")
    kinds = {c: joined.schema[c].dataType.simpleString() for c in ("doc", "source")}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "place", "block", "round", "words"]
        for rows, raw, at in text_blocks(batches, "text"):
            first, end = word_spans(raw, at)
            begin = np.searchsorted(first, at)
            row, numbers, texts = [], {n: [] for n in names}, []
            for d, wanted in enumerate(rows.column(3)):
                for w in wanted.as_py():
                    low = begin[d] + w["block"] * block
                    row.append(d)
                    texts.append(raw[first[low] : end[low + w["words"] - 1]].tobytes().decode())
                    for n in names:
                        numbers[n].append(w[n])
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).take(take),
                    rows.column(1).take(take),
                    *(pa.array(numbers[n], pa.int64()) for n in names),
                    pa.array(texts, pa.string()),
                ],
                names=["doc", "source", *names, "text"],
            )

    schema = f"doc {kinds['doc']}, source {kinds['source']}, shard bigint, place bigint, block bigint, round bigint, words bigint, text string"
    return joined.mapInArrow(pieces, schema).select(
        "shard", "place", F.col("doc").alias(key), F.col("source").alias(source), "block", "round", "words", "text"
    )

