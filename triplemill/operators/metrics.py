"""Scores of prediction tables.

Every metric is a handful of numbers per row, made by array functions inside
the row, and one aggregation over them. Nothing but those numbers is shuffled.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplemill import constants as C
from triplemill.functions.arrays import bag_overlap, bind, by_run, indexes, numbered
from triplemill.functions.rdf import coerce_triples, parse_triples
from triplemill.functions.text import common_subsequence, ngrams, strip, tokens

ORDERS = range(1, C.BLEU_ORDER + 1)


# --- numbers per row -------------------------------------------------------


def closest_length(size: Column, sizes: Column) -> Column:
    """The length nearest to ``size``, the shorter on a tie; 0 without any."""
    ranked = F.transform(sizes, lambda n: F.struct(F.abs(n - size).alias("d"), n.alias("n")))
    return F.coalesce(F.array_min(ranked)["n"], F.lit(0))


def bleu_row(pred: Column, refs: Column, single: bool = True) -> Column:
    """Clipped n-gram matches per order, prediction and reference length.

    ``refs`` is an array of reference texts, a ``single`` one in every row or
    any number. The union of their numbered
    n-grams holds each n-gram as often as the reference that has most of it.
    """

    def matches(p, rs, n):
        if single:
            return bag_overlap(ngrams(p, n), ngrams(F.get(rs, F.lit(0)), n)).cast("bigint")
        known = F.flatten(F.transform(rs, lambda r: numbered(ngrams(r, n))))
        return F.size(F.array_intersect(numbered(ngrams(p, n)), known)).cast("bigint")

    def counts(p, rs):
        size = F.size(p)
        return F.struct(
            F.array(*(matches(p, rs, n) for n in ORDERS)).alias("matches"),
            size.cast("bigint").alias("pred_len"),
            closest_length(size, F.transform(rs, F.size)).cast("bigint").alias("ref_len"),
        )

    return bind(tokens(pred), lambda p: bind(F.transform(refs, tokens), lambda rs: counts(p, rs)))


def rouge_row(common: Column, pred_len: Column, ref_len: Column) -> Column:
    """F score of the longest common subsequence."""
    beta2 = F.lit(C.ROUGE_BETA**2)
    prec = common / pred_len
    rec = common / ref_len
    return F.when(common > 0, (1 + beta2) * prec * rec / (rec + beta2 * prec)).otherwise(0.0)


def _matched_places(hyp: Column, ref: Column) -> Column:
    """Sorted places of the reference tokens that the hypothesis matches.

    Of a token that the hypothesis has k times, the first k copies in the
    reference match. Copies are numbered on both sides and sorted together; a
    reference copy matches if the same copy of the hypothesis stands before it.
    """
    place = F.sort_array(
        F.transform(ref, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    )
    theirs = bind(
        place,
        lambda s: by_run(
            s,
            lambda x, j: F.struct(
                F.concat(x["t"], F.lit(" "), j.cast("string")).alias("key"),
                x["i"].alias("at"),
            ),
            key=lambda x: x["t"],
        ),
    )
    ours = bind(
        F.sort_array(hyp),
        lambda s: by_run(
            s,
            lambda x, j: F.struct(
                F.concat(x, F.lit(" "), j.cast("string")).alias("key"), F.lit(-1).alias("at")
            ),
        ),
    )
    return bind(
        F.sort_array(F.concat(ours, theirs)),
        lambda s: F.sort_array(
            F.transform(
                F.filter(
                    s,
                    lambda x, i: (x["at"] >= 0)
                    & (i > 0)
                    & (F.get(s, F.greatest(i - 1, F.lit(0)))["key"] == x["key"]),
                ),
                lambda x: x["at"],
            )
        ),
    )


def meteor_row(pred: Column, ref: Column) -> Column:
    """Simplified METEOR: exact lower-case unigrams and a penalty per chunk."""

    def score(hyp_size, ref_size, places):
        matches = F.size(places).cast("double")
        chunks = F.size(
            F.filter(
                indexes(F.size(places)),
                lambda k: (k == 0)
                | (F.get(places, k) != F.get(places, F.greatest(k - 1, F.lit(0))) + 1),
            )
        )
        prec, rec = matches / hyp_size, matches / ref_size
        mean = prec * rec / (C.METEOR_ALPHA * prec + (1 - C.METEOR_ALPHA) * rec)
        penalty = C.METEOR_GAMMA * F.pow(chunks / matches, F.lit(C.METEOR_BETA))
        return F.when(matches > 0, (1 - penalty) * mean).otherwise(0.0)

    return bind(
        tokens(F.lower(pred)),
        lambda h: bind(
            tokens(F.lower(ref)),
            lambda r: bind(
                _matched_places(h, r), lambda places: score(F.size(h), F.size(r), places)
            ),
        ),
    )


def triple_row(pred: Column, ref: Column) -> Column:
    """Right, wrong and missed triples of two linearised texts, as sets."""

    # Parsed parts hold no white space, so a space joins them without doubt.
    def keys(x):
        return F.array_distinct(
            F.transform(parse_triples(x), lambda t: F.concat_ws(" ", t["s"], t["p"], t["o"]))
        )

    def counts(p, r, both):
        return F.struct(
            both.cast("bigint").alias("tp"),
            (F.size(p) - both).cast("bigint").alias("fp"),
            (F.size(r) - both).cast("bigint").alias("fn"),
        )

    return bind(
        keys(pred),
        lambda p: bind(
            keys(ref),
            lambda r: bind(F.size(F.array_intersect(p, r)), lambda both: counts(p, r, both)),
        ),
    )


def exact_row(pred: Column, ref: Column) -> Column:
    same = strip(F.coalesce(pred, F.lit(""))) == strip(F.coalesce(ref, F.lit("")))
    return same.cast("int")


# --- scores of a group -----------------------------------------------------


def bleu_of(matches: list[Column], possible: list[Column], pred_len, ref_len) -> Column:
    """Corpus BLEU (0-100) from summed counts."""
    logs = [
        F.log((m + F.lit(C.BLEU_SMOOTH)) / (t + F.lit(C.BLEU_SMOOTH)))
        for m, t in zip(matches, possible)
    ]
    mean = F.exp(sum(logs[1:], logs[0]) / len(logs))
    brevity = F.when(pred_len < ref_len, F.exp(1 - ref_len / pred_len)).otherwise(1.0)
    # Short of n-grams of some order (or without predictions) the score is 0.
    return F.when(F.least(*possible) > 0, mean * brevity * 100).otherwise(0.0)


def precision_recall(tp, fp, fn) -> dict[str, Column]:
    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    prec = ratio(tp, tp + fp)
    rec = ratio(tp, tp + fn)
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return {"precision": prec * 100, "recall": rec * 100, "f1": f1 * 100}


def _possible(pred_len, n):
    return F.sum(F.greatest(pred_len - (n - 1), F.lit(0)))


def _bleu_aggregate(row: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return bleu_of(
        [F.coalesce(F.sum(F.get(row["matches"], F.lit(n - 1))), zero) for n in ORDERS],
        [F.coalesce(_possible(row["pred_len"], n), zero) for n in ORDERS],
        F.coalesce(F.sum(row["pred_len"]), zero),
        F.coalesce(F.sum(row["ref_len"]), zero),
    )


def corpus_bleu(rows: DataFrame, by=()) -> DataFrame:
    """BLEU of ``pred`` against ``ref`` (a text or an array of texts)."""
    many = dict(rows.dtypes)["ref"].startswith("array")
    refs = F.col("ref") if many else F.array("ref")
    stats = rows.select(*by, bleu_row(F.col("pred"), refs, not many).alias("b"))
    return stats.groupBy(*by).agg(_bleu_aggregate(F.col("b")).alias("bleu"))


def with_rouge(rows: DataFrame, name="rouge") -> DataFrame:
    """Add the ROUGE-L score of each row."""
    sides = rows.withColumn("_p", tokens(F.col("pred"))).withColumn("_r", tokens(F.col("ref")))
    scored = rouge_row(
        common_subsequence("_p", "_r"), F.nullif(F.size("_p"), F.lit(0)), F.nullif(F.size("_r"), F.lit(0))
    )
    return sides.withColumn(name, scored).drop("_p", "_r")


def rouge_l(rows: DataFrame, by=()) -> DataFrame:
    mean = F.coalesce(F.avg("rouge"), F.lit(0.0)) * 100
    return with_rouge(rows).groupBy(*by).agg(mean.alias("rouge_l"))


def meteor(rows: DataFrame, by=()) -> DataFrame:
    score = rows.select(*by, meteor_row(F.col("pred"), F.col("ref")).alias("m"))
    mean = F.coalesce(F.avg("m"), F.lit(0.0)) * 100
    return score.groupBy(*by).agg(mean.alias("meteor"))


def triple_scores(rows: DataFrame, by=()) -> DataFrame:
    """Micro precision, recall and F1 of linearised ``pred`` and ``ref``."""
    stats = rows.select(*by, triple_row(F.col("pred"), F.col("ref")).alias("t"))
    sums = stats.groupBy(*by).agg(
        *(F.coalesce(F.sum(f"t.{c}"), F.lit(0)).alias(c) for c in ("tp", "fp", "fn"))
    )
    return _with_ratios(sums)


def _with_ratios(sums: DataFrame) -> DataFrame:
    ratios = precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select("*", *(c.alias(n) for n, c in ratios.items()))


def triple_sets(rows: DataFrame, by=()) -> DataFrame:
    """Long form ``(by, id, s, p, o, in_pred, in_ref)`` of rows whose ``pred``
    and ``ref`` are tagged text, arrays of lists or arrays of triples."""
    types = dict(rows.dtypes)

    def side(name, number):
        return F.transform(
            coerce_triples(F.col(name), types[name]),
            lambda t: F.struct(F.lit(number).alias("side"), t.alias("t")),
        )

    long = rows.select(*by, "id", F.explode(F.concat(side("pred", 0), side("ref", 1))).alias("x"))
    return triple_membership(
        long.select(*by, "id", "x.t.*", F.when(F.col("x.side") == 0, "pred").otherwise("ref").alias("side")),
        by,
    )


def triple_membership(long: DataFrame, by=()) -> DataFrame:
    """Which side has each triple, from ``(by, id, side, s, p, o)``.

    The key of the shuffle is the triple itself, so an item with very many
    triples is spread over all tasks.
    """
    return long.groupBy(*by, "id", "s", "p", "o").agg(
        F.bool_or(F.col("side") == "pred").alias("in_pred"),
        F.bool_or(F.col("side") == "ref").alias("in_ref"),
    )


def membership_scores(sets: DataFrame, by=()) -> DataFrame:
    sums = sets.groupBy(*by).agg(
        F.count_if(F.col("in_pred") & F.col("in_ref")).alias("tp"),
        F.count_if(F.col("in_pred") & ~F.col("in_ref")).alias("fp"),
        F.count_if(~F.col("in_pred") & F.col("in_ref")).alias("fn"),
    )
    return _with_ratios(sums)


def accuracy(rows: DataFrame, by=()) -> DataFrame:
    stats = rows.select(*by, exact_row(F.col("pred"), F.col("ref")).alias("e"))
    return stats.groupBy(*by).agg((F.coalesce(F.avg("e"), F.lit(0.0)) * 100).alias("accuracy"))


# --- all metrics by task ---------------------------------------------------

TRIPLE_TASKS = ("text2rdf", "rdfcomp2")
EXACT_TASKS = ("rdfcomp1",)
METRICS = {
    "text": ("bleu", "rouge_l", "meteor"),
    "triples": ("precision", "recall", "f1"),
    "exact": ("accuracy",),
}


def metric_kind(task: Column) -> Column:
    """Kind of metric a task is scored with; unknown tasks count as text."""
    return (
        F.when(task.isin(*TRIPLE_TASKS), "triples")
        .when(task.isin(*EXACT_TASKS), "exact")
        .otherwise("text")
    )


def metrics_by_task(rows: DataFrame, by=("split", "task")) -> DataFrame:
    """Long report ``(by, metric, value)`` of all tasks in one pass.

    A row is only worked on by the metrics of its task; one aggregation on the
    few groups follows.
    """
    kind = metric_kind(F.col("task"))
    pred, ref = F.col("pred"), F.col("ref")
    is_text = F.col("_kind") == "text"
    marked = rows.select(*by, "pred", "ref", kind.alias("_kind"))
    scored = (
        with_rouge(
            marked.withColumn("_pred", pred)
            .withColumn("_ref", ref)
            .withColumn("pred", F.when(is_text, pred))
            .withColumn("ref", F.when(is_text, ref))
        )
        .drop("pred", "ref")
        .withColumnsRenamed({"_pred": "pred", "_ref": "ref"})
        .select(
            *by,
            "_kind",
            F.when(is_text, F.col("rouge")).alias("r"),
            F.when(is_text, bleu_row(pred, F.array(ref))).alias("b"),
            F.when(is_text, meteor_row(pred, ref)).alias("m"),
            F.when(F.col("_kind") == "triples", triple_row(pred, ref)).alias("t"),
            F.when(F.col("_kind") == "exact", exact_row(pred, ref)).alias("e"),
        )
    )
    sums = {c: F.coalesce(F.sum(f"t.{c}"), F.lit(0)) for c in ("tp", "fp", "fn")}
    values = {
        "bleu": _bleu_aggregate(F.col("b")),
        "rouge_l": F.avg("r") * 100,
        "meteor": F.avg("m") * 100,
        **precision_recall(**sums),
        "accuracy": F.avg("e") * 100,
        "samples": F.count("*").cast("double"),
    }
    wide = scored.groupBy(*by, "_kind").agg(*(c.alias(n) for n, c in values.items()))
    wanted = F.lit(False)
    for name, metrics in METRICS.items():
        wanted = wanted | ((F.col("_kind") == name) & F.col("metric").isin(*metrics, "samples"))
    return wide.unpivot([*by, "_kind"], list(values), "metric", "value").where(wanted).drop("_kind")


# --- spans -----------------------------------------------------------------


def align_labels(pred_ids: Column, labels: Column) -> Column:
    """Labels may be one longer than the predictions: the first one is dropped."""
    n, m = F.size(pred_ids), F.size(labels)
    return (
        F.when(n == m, labels)
        .when(m == n + 1, F.slice(labels, F.lit(2), F.greatest(m - 1, F.lit(0))))
        .otherwise(F.raise_error(F.lit("labels must be as long as predictions or one longer")))
    )


def span_accuracy(rows: DataFrame, pad_id: int = 0, by=()) -> DataFrame:
    """Share of target spans predicted exactly, NULL without a valid span.

    ``spans`` is ``array<struct<start,len>>``; a span must lie inside the row
    and hold no padding.
    """

    def counts(labels):
        def valid(span):
            start, n = span["start"], span["len"]
            inside = (start >= 0) & (n > 0) & (start + n <= F.size(labels))
            return inside & F.coalesce(
                ~F.array_contains(
                    F.slice(labels, F.greatest(start, F.lit(0)) + 1, F.greatest(n, F.lit(0))),
                    F.lit(pad_id),
                ),
                F.lit(False),
            )

        def right(span):
            return F.slice(labels, span["start"] + 1, span["len"]) == F.slice(
                F.col("pred_ids"), span["start"] + 1, span["len"]
            )

        return bind(
            F.filter("spans", valid),
            lambda ok: F.struct(
                F.size(ok).alias("n"), F.size(F.filter(ok, right)).alias("hits")
            ),
        )

    stats = rows.select(
        *by, bind(align_labels(F.col("pred_ids"), F.col("labels")), counts).alias("c")
    )
    return stats.groupBy(*by).agg(
        F.coalesce(F.sum("c.n"), F.lit(0)).cast("bigint").alias("spans"),
        F.try_divide(F.sum("c.hits"), F.sum("c.n")).alias("mask_accuracy"),
    )
