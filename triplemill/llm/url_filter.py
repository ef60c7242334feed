"""URL filter: rules by host and path, and for the others a language model.

The urls that the rules decide are the examples. Two character models of order
``ORDER``, one of accepted and one of rejected urls, give each next character a
probability; each order is smoothed with the next lower one by the number of
different continuations of its context (Witten-Bell), so how much of the context
counts depends on what was seen after it. A url's score is the mean difference
of the two log probabilities. One url in ``HELD_OUT`` of the examples is not
counted but used to set the threshold where the mean of the two error rates is
least.

The models are tables: counts of windows of ``ORDER + 1`` characters, and level
by level the probabilities of their ends. A context has no more continuations
than there are characters, so none of these joins can be skewed. Windows of urls
are looked up in them by a join in which the most frequent windows go apart.
Scores are whole numbers, so sums do not depend on the partitioning.

A null url has no characters but the end mark, empty host and path, and gets the
verdict of the models; repeated rows are judged each; without examples of one
kind every url without rule is judged by the smoothed models all the same; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplemill.functions.arrays import indexes
from triplemill.llm.common import look_up
from triplemill.plans.scratch import written

# (allow?, host and path); a rule holds for its host and all subdomains.
RULES = (
    (True, "org/"),
    (False, "example.org/es/"),
    (False, "example.org/en/1"),
    (True, "com/fr/"),
    (False, "com/de/"),
)
ORDER = 5
BEGIN, END = "\x02", "\x03"
# Probability of a character of which nothing is known.
LEAST = 1 / 1024
HELD_OUT = 5
# Scores are summed in 1 / SCALE and compared in 1 / STEP.
SCALE, STEP = 1 << 20, 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, parts, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = (host == name) | F.endswith(host, F.lit("." + name))
        out = F.when(fits & F.startswith(path, F.lit("/" + rest)), rule).otherwise(out)
    return out


def windows(urls: DataFrame) -> DataFrame:
    """Each character of a url, and the end, with the ORDER characters before."""
    padded = F.concat(
        F.lit(BEGIN * ORDER), F.coalesce(F.col("url"), F.lit("")), F.lit(END)
    )
    return urls.withColumn(
        "gram",
        F.explode(
            F.transform(
                indexes(F.length(padded) - ORDER),
                lambda i: F.substring(padded, i + 1, F.lit(ORDER + 1)),
            )
        ),
    ).drop("url")


def model(grams: DataFrame) -> DataFrame:
    """``gram, diff``: log probability of the last character of each window
    among accepted minus among rejected urls, from ``gram, good, bad``."""
    below = None
    for k in range(ORDER + 1):
        end = F.substring("gram", ORDER + 1 - k, k + 1)
        ends = grams.groupBy(end.alias("s")).agg(
            F.sum("good").alias("good"), F.sum("bad").alias("bad")
        )
        context = F.substring("s", 1, k)
        contexts = ends.groupBy(context.alias("c")).agg(
            F.sum("good").alias("good_c"),
            F.sum("bad").alias("bad_c"),
            F.count(F.when(F.col("good") > 0, 1)).alias("good_t"),
            F.count(F.when(F.col("bad") > 0, 1)).alias("bad_t"),
        )
        level = ends.withColumn("c", context).join(contexts, "c").drop("c")
        if below is None:
            level = level.withColumn("good_p", F.lit(LEAST)).withColumn("bad_p", F.lit(LEAST))
        else:
            level = level.withColumn("b", F.substring("s", 2, k)).join(below, "b").drop("b")
        smooth = lambda x: F.when(
            F.col(f"{x}_c") + F.col(f"{x}_t") > 0,
            (F.col(x) + F.col(f"{x}_t") * F.col(f"{x}_p")) / (F.col(f"{x}_c") + F.col(f"{x}_t")),
        ).otherwise(F.col(f"{x}_p"))
        level = level.select("s", smooth("good").alias("good_p"), smooth("bad").alias("bad_p"))
        below = level.withColumnRenamed("s", "b")
    diff = F.log("good_p") - F.log("bad_p")
    return below.select(F.col("b").alias("gram"), F.round(diff * SCALE).cast("bigint").alias("diff"))


def threshold(examples: DataFrame) -> int:
    """Least step of the score that is allowed, from ``allowed, step``."""
    counts = examples.groupBy("step", "allowed").agg(F.count("*").alias("n")).collect()
    good, bad = {}, {}
    for r in counts:  # steps are cut to +-16 * STEP, so these are few
        (good if r["allowed"] else bad)[r["step"]] = r["n"]
    n_good, n_bad = sum(good.values()), sum(bad.values())
    if not n_good or not n_bad:
        return 0
    # Errors with the threshold just above all steps, then lower and lower.
    best, at = n_good * n_bad, max([*good, *bad]) + 1
    missed, wrong = n_good, 0
    for step in sorted({*good, *bad}, reverse=True):
        missed -= good.get(step, 0)
        wrong += bad.get(step, 0)
        errors = missed * n_bad + wrong * n_good
        if errors < best or (errors == best and abs(step) < abs(at)):
            best, at = errors, step
    return at


def judged(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: key, host, path, rule, verdict, score."""
    host, path = host_and_path(F.col("url"))
    rows = (
        pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
        .withColumn("host", host)
        .withColumn("path", path)
        .withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    )
    verdicts = F.lit(None).cast("boolean")
    for allow, rule in rules:
        verdicts = F.when(F.col("rule") == rule, F.lit(allow)).otherwise(verdicts)
    rows = rows.withColumn("allowed", verdicts).withColumn(
        "mark", F.xxhash64(F.coalesce("url", F.lit("")))
    )
    counted = F.col("allowed").isNotNull() & (F.pmod("mark", F.lit(HELD_OUT)) != 0)
    parts = windows(rows.select("key", "mark", "url", "allowed", counted.alias("counted")))
    one = lambda which: F.count(F.when(F.col("counted") & which, 1))
    grams = written(
        parts.groupBy("gram").agg(
            one(F.col("allowed")).alias("good"),
            one(~F.col("allowed")).alias("bad"),
            F.count("*").alias("n"),
        )
    )
    table = written(model(grams).join(grams.select("gram", "n"), "gram"))
    scores = written(
        look_up(parts.select("key", "mark", "gram"), table, "gram", "n")
        .groupBy("key", "mark")
        .agg(F.sum("diff").alias("total"), F.count("*").alias("length"))
    )
    step = F.floor(F.col("total") / (F.col("length") * (SCALE // STEP)))
    most = 16 * STEP
    scores = scores.withColumn(
        "step", F.least(F.greatest(step, F.lit(-most)), F.lit(most)).cast("int")
    ).withColumnsRenamed({"key": "its_key", "mark": "its_mark"})
    same = F.col("key").eqNullSafe(F.col("its_key")) & (F.col("mark") == F.col("its_mark"))
    rows = rows.join(scores, same)
    held = rows.where(F.col("allowed").isNotNull() & (F.pmod("mark", F.lit(HELD_OUT)) == 0))
    cut = threshold(held.select("allowed", "step"))
    allowed = F.coalesce("allowed", F.col("step") >= cut)
    return rows.select(
        F.col("key").alias(key),
        "host",
        "path",
        "rule",
        F.when(allowed, "allow").otherwise("block").alias("verdict"),
        (F.col("total") / (F.col("length") * SCALE)).alias("score"),
    )
