"""Quality rules: counts per document, and outliers by a robust covariance.

Native: DataFrame functions only. A document fails the base rules by its counts.
Of the others a vector of five statistics is taken, and per language and source
the mean and covariance of the half-and-more of documents that lie closest
together (minimum covariance determinant). A document whose vector is far from
its group by the Mahalanobis distance is rejected.

* The vectors are whole numbers (1/256ths), so all sums are exact and the result
  does not depend on the partitioning.
* A concentration step needs the documents below the ``SHARE`` quantile of the
  distance in their group. Sums are kept per group and interval of the distance,
  so a step is one aggregation of a few numbers per group, however large a group
  is; the intervals up to the quantile are then added up.
* Every step starts twice: from medians and quartiles, and from all documents.
  The start that ends with the smaller determinant is taken.
* Variances get a floor per statistic, the error of measuring it in a short
  document. Without one, a statistic that is zero for most documents would make any
  other value an outlier. Each statistic alone can reject a document.
* The statistics of clean text are skewed, so the normal quantile would reject too
  many. The bound of a group follows the spread of its own distances, from their
  median to their ``BULK`` quantile (interval counts again), and is never below the
  normal one. Up to 15 of 100 documents of a group may be outliers.
* Groups under ``MIN_GROUP`` documents are pooled by language, and what is still
  smaller in one remainder.

A null text has no words and so fails the base rules; a null language or source
is a group of its own; rows that are repeated are judged each; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplemill.functions.arrays import bind, indexes
from triplemill.llm.common import BLANK, tag, words
from triplemill.plans.scratch import written

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS = 50
MIN_GROUP = 200
PLACE_BITS = 30  # a string holds 2 GB, and so at most 2^30 words
PLACE = (1 << PLACE_BITS) - 1
SHARE = 0.75
STEPS = 4
UNIT = 256
# Standard deviations that are added to each statistic's own, in its units:
# log of the mean word length, and square roots of the shares of symbols,
# repeated lines, repeated words and capitals. The root of a share of n has an
# error of 0.5 / sqrt(n), the log of a mean word length about as much: taken for
# 100 words, 500 characters, 25 lines, and 100 words that repeat three at a time.
FLOORS = (0.05, 0.022, 0.1, 0.087, 0.022)
P = len(FLOORS)
X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
# share / P(chi2 with P+2 degrees < its SHARE quantile for P degrees): makes the
# covariance of the inner SHARE that of the whole, for five normal statistics.
CONSISTENT = 1.412
# Distances squared beyond this are outliers at least: the 0.999 quantile of chi2
# with 5 degrees, so 1 of 1,000 normal documents is rejected wrongly, with floors
# fewer.
CUTOFF = 20.515
BULK = 0.85
# On the log scale the 0.999 quantile of chi2 with 5 degrees (20.515) is this many
# times as far above the 0.85 quantile (8.115) as that is above the median (4.351).
TAIL = 1.488
# Doublings from the median to the BULK quantile that count at most: where most
# documents are copies of one, the median says nothing about the rest.
WIDEST = 3.0


def counted(docs: DataFrame) -> DataFrame:
    """Counts of ``text``, in stages so that each array is made once.

    A 3-word window is one number: 40 bits of its hash and its position. Sorted,
    equal windows stand side by side. Neighbours that agree in the hash are
    compared word by word; should a hash ever stand for two different windows of
    a text, that text's windows are sorted as strings instead.
    """
    w = F.col("w")

    def window(i):
        return [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]

    place = lambda k: F.get(F.col("packed"), k).bitwiseAND(F.lit(PLACE)).cast("int")
    head = lambda k: F.shiftright(F.get(F.col("packed"), k), PLACE_BITS)
    every = indexes(F.size(w) - 2)
    packed = F.transform(
        every,
        lambda i: F.xxhash64(*window(i)).bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("bigint")),
    )
    unlike = F.exists(
        F.col("pairs"),
        lambda k: bind(
            place(k), lambda i: bind(place(k + 1), lambda j: F.array(*window(i)) != F.array(*window(j)))
        ),
    )
    plainly = F.sort_array(
        F.transform(every, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("t"), i.alias("i")))
    )
    equal = bind(
        plainly,
        lambda s: F.flatten(
            F.transform(
                F.filter(
                    indexes(F.size(s) - 1), lambda k: F.get(s, k)["t"] == F.get(s, k + 1)["t"]
                ),
                lambda k: F.array(F.get(s, k)["i"], F.get(s, k + 1)["i"]),
            )
        ),
    )
    near = F.flatten(F.transform(F.col("pairs"), lambda k: F.array(place(k), place(k + 1))))
    at = F.col("at")
    covered = F.aggregate(
        indexes(F.size(at)),
        F.lit(0),
        lambda total, k: total
        + F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - F.get(at, k), F.lit(3))),
    )
    big = lambda c: c.cast("bigint")
    text = F.coalesce("text", F.lit(""))
    marks, lines = F.col("marks"), F.col("lines")
    n_marks, n_symbols = F.length(marks), F.length(F.translate(marks, CAPITALS, ""))
    keep = [c for c in docs.columns if c != "text"]
    return (
        docs.select(
            *keep,
            words(F.col("text")).alias("w"),
            F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
            F.regexp_replace(text, f"[^{SYMBOLS}A-Z]+", "").alias("marks"),
        )
        .withColumn("packed", F.sort_array(packed))
        .withColumn(
            "pairs", F.filter(indexes(F.size("packed") - 1), lambda k: head(k) == head(k + 1))
        )
        .withColumn("at", F.sort_array(F.array_distinct(F.when(unlike, equal).otherwise(near))))
        .select(
            *keep,
            big(F.size(w)).alias("n_words"),
            big(F.length(F.concat_ws("", w))).alias("word_chars"),
            big(n_symbols).alias("n_symbols"),
            big(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
            big(covered).alias("n_repeat_words"),
            big(F.size(lines)).alias("n_lines"),
            big(n_marks - n_symbols).alias("n_capitals"),
        )
    )


def vector() -> list[Column]:
    """The statistics, from the counts, in whole units."""
    share = lambda part, whole: F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    values = [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
        share("n_capitals", "word_chars"),
    ]
    return [F.round(v * UNIT).cast("bigint").alias(x) for v, x in zip(values, X, strict=True)]


def with_groups(rows: DataFrame) -> DataFrame:
    """Group of each row: language and source, or what small groups share."""
    sizes = rows.where("not failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < MIN_GROUP)
    pools = small.groupBy("lang").agg(F.sum("n").alias("pool"))
    own = F.concat_ws("\x01", "lang", "source")
    # Few rows, written so that Spark joins them by their known size: the rows of
    # a large source then stay where they are.
    named = sizes.join(pools, "lang", "left").select(
        "lang",
        "source",
        F.when(F.col("n") >= MIN_GROUP, F.concat(F.lit("s"), own))
        .when(F.col("pool") >= MIN_GROUP, F.concat(F.lit("l"), "lang"))
        .otherwise("rest")
        .alias("grp"),
    )
    return rows.join(written(named.coalesce(1)), ["lang", "source"], "left")


def quartiles(inner: DataFrame) -> DataFrame:
    """Start from the medians and quartiles, each statistic on its own."""
    counts = (
        inner.select(
            "grp",
            F.explode(
                F.array(*[F.struct(F.lit(i).alias("k"), F.col(x).alias("x")) for i, x in enumerate(X)])
            ).alias("s"),
        )
        .groupBy("grp", "s.k", "s.x")
        .agg(F.count("*").alias("n"))
    )
    so_far = Window.partitionBy("grp", "k").orderBy("x")
    ranked = counts.withColumn("up", F.sum("n").over(so_far)).withColumn(
        "total", F.sum("n").over(Window.partitionBy("grp", "k"))
    )
    at = lambda q, k: F.min(F.when((F.col("k") == k) & (F.col("up") >= F.col("total") * q), F.col("x")))
    spread = [
        F.pow((at(0.75, k) - at(0.25, k)) / 1.349, 2) + F.pow(F.lit(FLOORS[k] * UNIT), 2)
        for k in range(P)
    ]
    return ranked.groupBy("grp").agg(
        F.lit(0).alias("start"),
        *[at(0.5, k).cast("double").alias(f"m{k}") for k in range(P)],
        *[
            (1 / spread[i] if i == j else F.lit(0.0)).alias(f"p{i}{j}")
            for i, j in PAIRS
        ],
    )


def moments() -> list[Column]:
    return [
        F.count("*").alias("n"),
        *[F.sum(x).alias(f"s{i}") for i, x in enumerate(X)],
        *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}{j}") for i, j in PAIRS],
    ]


def estimate(sums: DataFrame) -> DataFrame:
    """Mean, inverse covariance and log determinant from the sums of a group."""
    n = F.col("n")
    out = sums.select(
        "grp",
        "start",
        *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(P)],
        *[
            (
                F.col(f"q{i}{j}") / n
                - (F.col(f"s{i}") / n) * (F.col(f"s{j}") / n)
                + F.lit((FLOORS[i] * UNIT) ** 2 if i == j else 0.0)
            ).alias(f"c{i}{j}")
            for i, j in PAIRS
        ],
    )
    # Cholesky factor l, its inverse w, and the inverse covariance p.
    for j in range(P):
        for i in range(j, P):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", value)
    for j in range(P):
        out = out.withColumn(f"w{j}{j}", 1 / F.col(f"l{j}{j}"))
        for i in range(j + 1, P):
            rest = F.lit(0.0)
            for k in range(j, i):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
            out = out.withColumn(f"w{i}{j}", rest / F.col(f"l{i}{i}"))
    inverse = []
    for i, j in PAIRS:
        entry = F.lit(0.0)
        for k in range(i, P):
            entry = entry + F.col(f"w{k}{i}") * F.col(f"w{k}{j}")
        inverse.append(entry.alias(f"p{i}{j}"))
    logdet = F.lit(0.0)
    for i in range(P):
        logdet = logdet + 2 * F.log(F.col(f"l{i}{i}"))
    return out.select(
        "grp", "start", *[f"m{i}" for i in range(P)], *inverse, logdet.alias("logdet")
    )


def distance() -> Column:
    """Mahalanobis distance squared of x from m under p."""
    off = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(X)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        term = F.col(f"p{i}{j}") * off[i] * off[j]
        total = total + (term if i == j else 2 * term)
    return F.greatest(total, F.lit(0.0))


def concentrate(inner: DataFrame, now: DataFrame) -> DataFrame:
    """Estimates from the documents nearest to the ones given."""
    interval = F.floor(F.log2(distance() + 1e-6) * 16).cast("int")
    by_interval = (
        inner.join(now, "grp")
        .select("grp", "start", interval.alias("bin"), *X)
        .groupBy("grp", "start", "bin")
        .agg(*moments())
    )
    whole = Window.partitionBy("grp", "start")
    near = (
        by_interval.withColumn("up", F.sum("n").over(whole.orderBy("bin")))
        .withColumn("total", F.sum("n").over(whole))
        .where(F.col("up") - F.col("n") < F.col("total") * SHARE)
    )
    names = ["n", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in PAIRS]]
    return estimate(near.groupBy("grp", "start").agg(*[F.sum(c).alias(c) for c in names]))


def robust_estimates(inner: DataFrame) -> DataFrame:
    """Mean and inverse covariance per group: grp, m0.., p00.."""
    everything = estimate(
        inner.groupBy("grp").agg(*moments()).withColumn("start", F.lit(1))
    ).drop("logdet")
    now = written(quartiles(inner).unionByName(everything).coalesce(1))
    for _ in range(STEPS):
        now = written(concentrate(inner, now).coalesce(1))
    best = Window.partitionBy("grp").orderBy("logdet", "start")
    return written(
        now.withColumn("place", F.row_number().over(best))
        .where("place = 1")
        .drop("place", "start", "logdet")
        .coalesce(1)
    )


def bounds(inner: DataFrame, best: DataFrame) -> DataFrame:
    """Distance squared beyond which a document of a group is an outlier."""
    interval = F.floor(F.log2(distance() / CONSISTENT + 1e-6) * 16).cast("int")
    counts = (
        inner.join(best, "grp").select("grp", interval.alias("bin")).groupBy("grp", "bin").agg(F.count("*").alias("n"))
    )
    whole = Window.partitionBy("grp")
    ranked = counts.withColumn("up", F.sum("n").over(whole.orderBy("bin"))).withColumn(
        "total", F.sum("n").over(whole)
    )
    at = lambda q: (F.min(F.when(F.col("up") >= F.col("total") * q, F.col("bin"))) + 0.5) / 16
    quantiles = ranked.groupBy("grp").agg(at(0.5).alias("half"), at(BULK).alias("bulk"))
    wide = F.least(F.col("bulk") - F.col("half"), F.lit(WIDEST))
    own = F.pow(F.lit(2.0), F.col("bulk") + TAIL * wide)
    return written(quantiles.select("grp", F.greatest(F.lit(CUTOFF), own).alias("bound")).coalesce(1))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judged(docs: DataFrame, key: str = "doc_id", text="text", lang="lang", source="source"):
    """One row per document: key, counts, base_failed, distance, kept."""
    counts = counted(
        docs.select(
            F.col(key).alias("key"),
            tag(F.col(lang)).alias("lang"),
            tag(F.col(source)).alias("source"),
            F.col(text).alias("text"),
        )
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    )
    rows = written(counts.select("key", "lang", "source", *COUNTS, failed.alias("failed"), *vector()))
    rows = with_groups(rows)
    inner = rows.where("not failed").select("grp", *X)
    best = robust_estimates(inner)
    best = best.join(bounds(inner, best), "grp")
    far = F.when(~F.col("failed"), distance() / CONSISTENT)
    return rows.join(best, "grp", "left").select(
        F.col("key").alias(key),
        *COUNTS,
        F.col("failed").alias("base_failed"),
        far.alias("distance"),
        (~F.col("failed") & F.coalesce(far <= F.col("bound"), F.lit(True))).alias("kept"),
    )
