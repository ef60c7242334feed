"""Toxicity scores learned from confirmed toxic documents and unlabelled text.

Non-negative positive-unlabelled learning. Only confirmed examples are labelled
data; everything else is a mixture in which the share of toxic text is the class
prior, taken from the labels. The risk of a classifier is estimated as
``prior * loss(positives as toxic) + max(0, loss(unlabelled as clean) - prior *
loss(positives as clean))``: the last term is what unlabelled text would lose if its
toxic part were taken out, and it cannot be negative. Where it becomes so, the step
goes the other way, so that the classifier doesn't learn the examples by heart.

Features are the densities (per letter byte) of whole words and of byte strings of
``GRAMS`` lengths inside words, hashed into ``BUCKETS``; only the ``KEPT`` buckets
that are most clearly denser in the confirmed sample have a weight. ``MEMBERS`` classifiers are
trained by numpy, each in a task of its own and without one part of the sample; on
that part its output is brought to the scale of probabilities by the same risk. The
score is the mean of their logits, as a probability, and one linear function.

The samples are bounded: ``MOST_POSITIVE`` confirmed and ``MOST_UNLABELLED`` other
documents (expected numbers at most), taken by hash; rows that repeat count once.
Every document is scored, whole.

Labels are read only for documents whose crc32(key as text) mod 4 is not ``HELD``.
A label row with a null key or label is left out; a document is confirmed when any
of its label rows says so. A null or empty text has no features and gets the score
that no features give. A null key counts as empty text for the remainder. Repeated
rows are scored each. Without positive examples all scores are 0; without unlabelled
text the prior. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplemill.llm.common import LOWER, blocks, mix, powers, word_spans
from triplemill.plans.scratch import written

HELD = 2
MOST_POSITIVE = 8_192
MOST_UNLABELLED = 16_384
MEMBERS = 4
BUCKETS = 1 << 18
KEPT = 512
# Standard errors by which a kept feature is denser in the confirmed sample.
CLEAR = 2.5
# Texts of the confirmed sample that a kept feature must be in.
LEAST_TEXTS = 3
GRAMS = (4, 6)
# Bytes of text whose features are in memory at a time.
BLOCK = 1 << 20
# Letter bytes added to every text, so that one word in a short one isn't all of it.
PADDING = 150
# Unlabelled rows of a step (half as many positive ones), passes over them, and the
# steps that are made at least.
BATCH = 512
EPOCHS = 30
LEAST_STEPS = 400
# Densities are multiplied by this: one feature in 1,000 letter bytes counts 1.
SCALE = 1_000.0

# Bytes that are no letters: everything of ASCII but A-Z and a-z.
NO_LETTER = np.zeros(256, bool)
NO_LETTER[:128] = True
NO_LETTER[65:91] = False
NO_LETTER[97:123] = False


# --- features -------------------------------------------------------------------


def feature_buckets(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of some texts, the text of each, and the texts'
    letter bytes."""
    raw = LOWER[raw]
    first, end = word_spans(raw, at, NO_LETTER)
    size = end - first
    text_of = np.searchsorted(at, first, "right") - 1
    letters = np.bincount(text_of, size, len(at) - 1)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) + np.repeat(first - begin, size)
    inside = raw[place].astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(first)), size)
    left = np.repeat(end, size) - place
    buckets, texts = [], []
    with np.errstate(over="ignore"):
        # Whole words: bytes times powers by place, so lengths count, too.
        power = powers(int(size.max()) + 1)[place - np.repeat(first, size)]
        whole = np.add.reduceat(inside * power, begin) ^ (size.astype(np.uint64) << np.uint64(48))
        buckets.append(mix(whole))
        texts.append(text_of)
        for n in GRAMS:
            start = np.flatnonzero(left >= n)
            h = np.full(len(start), n, np.uint64)
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + inside[start + i]
            buckets.append(mix(h))
            texts.append(text_of[word[start]])
    bucket = (np.concatenate(buckets) >> np.uint64(46)).astype(np.int64)
    return bucket, np.concatenate(texts), letters


assert BUCKETS == 1 << (64 - 46)


def pieces(batch: pa.RecordBatch):
    """Texts a block at a time: place of the rows in the batch, buckets, texts,
    letter bytes. A text is never cut."""
    row = 0
    for part, raw, at in blocks(iter([batch]), "text", BLOCK):
        yield row, part.num_rows, *feature_buckets(raw, at)
        row += part.num_rows


def densities(bucket, text, letters, place):
    """Sparse ``(text, kept feature, density)`` of the buckets with a place."""
    slot = place[bucket]
    hit = slot >= 0
    code, n = np.unique(text[hit] * KEPT + slot[hit], return_counts=True)
    of = code // KEPT
    return of, code % KEPT, n * SCALE / (letters[of] + PADDING)


# --- samples --------------------------------------------------------------------


def held_out(key: Column) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 4 == HELD


def by_hash(share: float, *columns: str) -> Column:
    """Whether a row is in a sample of this share."""
    return F.pmod(F.xxhash64(*columns, F.lit(11)), F.lit(1_000_000)) < int(share * 1_000_000)


def samples(rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """Rows of the samples with ``positive`` and ``fold``, and the class prior."""
    taught = labels.where("key is not null and toxic is not null").where(~held_out(F.col("key")))
    taught = taught.groupBy("key").agg(F.max("toxic").alias("toxic"))
    sizes = taught.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("toxic")).first()
    known = rows.where(~held_out(F.col("key")))
    # As many keys as the sample may have go to every task; the texts stay in place.
    first = taught.where("toxic = 1").orderBy(F.xxhash64("key", F.lit(7)), "key").limit(MOST_POSITIVE)
    keys = F.broadcast(written(first.select("key")))

    def taken(of: DataFrame, most: int, column: str) -> DataFrame:
        return of.where(by_hash(min(1.0, most / max(1, of.select(column).count())), "key", "text"))

    positive = taken(known.join(keys, "key", "left_semi"), MOST_POSITIVE, "key")
    unlabelled = taken(known, MOST_UNLABELLED, "key")
    fold = F.pmod(F.xxhash64("key", "text", F.lit(23)), F.lit(MEMBERS)).cast("int")
    both = (
        positive.withColumn("positive", F.lit(True))
        .unionByName(unlabelled.withColumn("positive", F.lit(False)))
        .withColumns({"fold": fold, "h": F.xxhash64("key", "text")})
        # Rows repeated very often are one each.
        .dropDuplicates(["positive", "key", "h"])
    )
    prior = sizes["toxic"] / sizes["n"] if sizes["n"] else 0.0
    return written(both), prior


def telling(sample: DataFrame) -> np.ndarray:
    """Place of each kept bucket, -1 for others: those whose mean density is higher
    in the confirmed sample by most errors. Sums of a task are made in it."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, 2 * BUCKETS))
        for batch in batches:
            positive = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, _, bucket, text, letters in pieces(batch):
                code, count = np.unique(text * BUCKETS + bucket, return_counts=True)
                density = count * SCALE / (letters[code // BUCKETS] + PADDING)
                place = positive[row + code // BUCKETS] * BUCKETS + code % BUCKETS
                total[0] += np.bincount(place, density, 2 * BUCKETS)
                total[1] += np.bincount(place, density**2, 2 * BUCKETS)
                total[2] += np.bincount(place, minlength=2 * BUCKETS)
        used = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used // BUCKETS, pa.int32()),
                pa.array(used % BUCKETS, pa.int32()),
                *(pa.array(t[used]) for t in total),
            ],
            names=["side", "bucket", "total", "squares", "texts"],
        )

    parts = sample.select("text", "positive").mapInArrow(
        add, "side int, bucket int, total double, squares double, texts double"
    )
    added = parts.groupBy("side", "bucket").agg(
        *(F.sum(c).alias(c) for c in ("total", "squares", "texts"))
    )
    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n = {1: sizes.get(True, 0), 0: sizes.get(False, 0)}

    def side(which: int) -> DataFrame:
        rows = added.where(F.col("side") == which)
        mean, square = F.col("total") / n[which], F.col("squares") / n[which]
        return rows.select(
            "bucket",
            mean.alias(f"mean{which}"),
            ((square - mean * mean) / n[which]).alias(f"error{which}"),
            F.col("texts").alias(f"texts{which}"),
        )

    both = side(1).where(F.col("texts1") >= LEAST_TEXTS).join(side(0), "bucket", "left").na.fill(0.0)
    strength = (F.col("mean1") - F.col("mean0")) / F.sqrt(F.col("error0") + F.col("error1") + 1e-9)
    clear = both.select("bucket", F.round(strength, 6).alias("strength")).where(F.col("strength") >= CLEAR)
    chosen = clear.orderBy(F.desc("strength"), "bucket").limit(KEPT).collect()
    place = np.full(BUCKETS, -1, np.int64)
    place[sorted(r["bucket"] for r in chosen)] = np.arange(len(chosen))
    return place


# --- training -------------------------------------------------------------------


def log1pexp(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def adam(x: np.ndarray, slope: np.ndarray, state: list, rate: float) -> np.ndarray:
    """One step of Adam; ``state`` holds the steps so far and both averages."""
    state[0] += 1
    state[1] = 0.9 * state[1] + 0.1 * slope
    state[2] = 0.999 * state[2] + 0.001 * slope * slope
    mean, square = state[1] / (1 - 0.9 ** state[0]), state[2] / (1 - 0.999 ** state[0])
    return x - rate * mean / (np.sqrt(square) + 1e-8)


def trained(x, positive, prior: float, seed: int, rate: float = 0.02, decay: float = 2e-3):
    """Weights and bias of the least non-negative risk, by Adam on small batches.

    Positive rows cost ``log1pexp(-z)`` as toxic and ``log1pexp(z)`` as clean ones.
    """
    rng = np.random.default_rng(seed)
    xp, xu = x[positive], x[~positive]
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(prior / (1.0 - prior))
    state = [0, np.zeros_like(w), np.zeros_like(w)]
    rounds = max(1, len(xu) // BATCH)
    for _ in range(max(EPOCHS, LEAST_STEPS // rounds)):
        order = rng.permutation(len(xu))
        for low in range(0, rounds * BATCH, BATCH):
            of_u = xu[order[low : low + BATCH]]
            of_p = xp[rng.integers(0, len(xp), BATCH // 2)] if len(xp) > BATCH // 2 else xp
            flat = w[:-1].astype(np.float32)
            zp, zu = of_p @ flat + w[-1], of_u @ flat + w[-1]
            # Slopes of the three terms of the risk by the outputs.
            toxic = -prior * sigmoid(-zp) / len(zp)
            spared = prior * sigmoid(zp) / len(zp)
            clean = sigmoid(zu) / len(zu)
            if log1pexp(zu).mean() >= prior * log1pexp(zp).mean():
                by_p, by_u = toxic - spared, clean
            else:
                by_p, by_u = spared, -clean
            slope = of_p.T @ by_p.astype(np.float32) + of_u.T @ by_u.astype(np.float32)
            slope = np.append(slope + decay * w[:-1], by_p.sum() + by_u.sum())
            w = adam(w, slope, state, rate)
    return w[:-1], w[-1]


def to_scale(zp, zu, prior: float, steps: int = 300, rate: float = 0.05) -> tuple[float, float]:
    """Slope and offset that bring outputs for unseen rows to logits, by the same
    risk; as they are if either side has none."""
    x = np.zeros(2)  # logarithm of the slope, offset
    state = [0, np.zeros(2), np.zeros(2)]
    for _ in range(steps if len(zp) and len(zu) else 0):
        k = np.exp(x[0])
        up, uu = k * zp + x[1], k * zu + x[1]
        toxic = -prior * np.array([k * (sigmoid(-up) * zp).mean(), sigmoid(-up).mean()])
        spared = prior * np.array([k * (sigmoid(up) * zp).mean(), sigmoid(up).mean()])
        clean = np.array([k * (sigmoid(uu) * zu).mean(), sigmoid(uu).mean()])
        fits = log1pexp(uu).mean() >= prior * log1pexp(up).mean()
        x = adam(x, toxic + clean - spared if fits else spared - clean, state, rate)
    return float(np.exp(x[0])), float(x[1])


def member_of(prior: float):
    """Train one classifier on the rows that are not of its fold."""

    def train(table: pa.Table) -> pa.Table:
        member = table.column("member")[0].as_py()
        table = table.sort_by([("h", "ascending"), ("positive", "ascending")])
        x = np.zeros((len(table), KEPT), np.float32)
        for i, (slots, values) in enumerate(
            zip(table.column("slots").to_pylist(), table.column("values").to_pylist(), strict=True)
        ):
            x[i, slots] = values
        positive = table.column("positive").to_numpy().astype(bool)
        unseen = table.column("fold").to_numpy() == member
        seen = ~unseen
        if not (seen & positive).any() or not (seen & ~positive).any():
            seen, unseen = np.ones(len(x), bool), np.zeros(len(x), bool)
        w, b = trained(x[seen], positive[seen], prior, member)
        z = x[unseen] @ w + b
        slope, offset = to_scale(z[positive[unseen]], z[~positive[unseen]], prior)
        return pa.table(
            {"member": pa.array([member], pa.int32()), "w": [(slope * w).tolist()], "b": [float(slope * b + offset)]}
        )

    return train


def learned(rows: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weight of every bucket and the bias of the mean logit."""
    none = np.zeros(BUCKETS, np.float32)
    sample, prior = samples(rows, labels)
    here = {r["positive"] for r in sample.select("positive").distinct().collect()}
    if True not in here or not prior:
        return none, -np.inf
    prior = min(prior, 0.99)
    if False not in here:
        return none, float(np.log(prior / (1.0 - prior)))
    place = telling(sample)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, values = [None] * batch.num_rows, [None] * batch.num_rows
            for row, n, *found, letters in pieces(batch):
                of, slot, density = densities(*found, letters, place)
                cut = np.searchsorted(of, np.arange(n + 1))
                for i in range(n):
                    slots[row + i] = slot[cut[i] : cut[i + 1]]
                    values[row + i] = density[cut[i] : cut[i + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    batch.column(2),
                    batch.column(3),
                    pa.array(slots, pa.list_(pa.int32())),
                    pa.array(values, pa.list_(pa.float32())),
                ],
                names=["positive", "fold", "h", "slots", "values"],
            )

    small = written(
        sample.select("text", "positive", "fold", "h").mapInArrow(
            reduce, "positive boolean, fold int, h bigint, slots array<int>, values array<float>"
        )
    )
    # Each member has a task; the samples are bounded, and so is what it holds.
    each = small.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(MEMBERS - 1))))
    members = (
        each.groupBy("member")
        .applyInArrow(member_of(prior), "member int, w array<double>, b double")
        .orderBy("member")
        .collect()
    )
    weights = none.copy()
    kept = np.flatnonzero(place >= 0)
    weights[kept] = np.mean([r["w"] for r in members], axis=0)[place[kept]]
    return weights, float(np.mean([r["b"] for r in members]))


# --- scores ---------------------------------------------------------------------


def scored(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> DataFrame:
    """One row per document: key, held_out, score, predicted."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    told = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic"))
    # One number a bucket, whatever the table.
    model = docs.sparkSession.sparkContext.broadcast(learned(rows, told))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for row, n, bucket, of, letters in pieces(batch):
                added = np.bincount(of, weights[bucket], n)
                total[row : row + n] = added * SCALE / (letters + PADDING)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sigmoid(total + bias))],
                names=["key", "held_out", "score"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    return (
        rows.select("key", held_out(F.col("key")).alias("held_out"), "text")
        .mapInArrow(judge, f"key {kind}, held_out boolean, score double")
        .select(
            F.col("key").alias(key),
            "held_out",
            "score",
            (F.col("score") >= threshold).cast("int").alias("predicted"),
        )
    )
