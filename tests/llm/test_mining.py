"""Toxicity, hard negatives and importance resampling against plain versions, on
small tables with odd rows and on whole given ones."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from triplemill.llm import hard_negatives, importance, toxicity

DOCUMENTS = "doc_id bigint, text string, lang string, key string, rank int, score string, weight int"


def documents_of(spark, rows):
    """Documents with columns whose names clash with those of the results."""
    return spark.createDataFrame([(i, t, "en", "k", 1, "s", 2) for i, t in rows], DOCUMENTS)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(7)
    letters = [f"w{i}" for i in range(200)]
    base = " ".join(rng.choices(letters, k=60))
    return [
        (1, base),
        (2, base),
        (2, base),
        (3, base.upper() + " École ÉCOLE"),
        (4, None),
        (5, ""),
        (6, " \t\n.,;"),
        (7, " ".join(rng.choices(letters, k=40_000))),
        (8, "x" * 100_000),
        (9, "a-b_c d1e2 \x00é\x7fü"),
        (None, base),
        (None, None),
        (-3, "one two three " * 9),
    ]


# --- 13 ---------------------------------------------------------------------------


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def plain_draw(docs, target, max_n=1, n=10_000, percent=10, least=20, seed=2024):
    def features(text):
        words = plain_words(text)
        for k in range(1, max_n + 1):
            for i in range(len(words) - k + 1):
                yield zlib.crc32(" ".join(words[i : i + k]).encode()) % n

    corpus = Counter(b for _, t in docs for b in features(t))
    aim = Counter(b for t in target for b in features(t))
    all_s, all_t = float(corpus.total() + n), float(aim.total() + n)
    out = []
    for key, text in docs:
        weight = sum(
            math.floor(1000 * math.log(float(aim[b] + 1) * all_s / (float(corpus[b] + 1) * all_t)))
            for b in features(text)
        )
        digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
        noise = math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))
        out.append([key, sum(1 for _ in features(text)), weight, weight + noise, len(plain_words(text))])
    eligible = [r for r in out if r[4] >= least]
    eligible.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, row in enumerate(eligible):
        row.append(place + 1 if place < len(eligible) * percent // 100 else None)
    return sorted([(*r[:4], r[5] if len(r) > 5 else None) for r in out], key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("max_n", [1, 2, 3])
def test_importance(spark, odd_texts, max_n, monkeypatch):
    monkeypatch.setattr(importance, "HEAD", 50)
    aim = ["w1 w2 w3 w1 w2", None, "", "école é w7 w7"]
    target = spark.createDataFrame([(i, t, "x") for i, t in enumerate(aim)], "item_id int, text string, key string")
    got = importance.resampled(documents_of(spark, odd_texts), target, max_n=max_n, percent=50)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows_of(got) == plain_draw(odd_texts, aim, max_n=max_n, percent=50)


def test_importance_pieces(monkeypatch):
    """Words and runs are the same however small the pieces of a text are."""
    text = "Some words, and some MORE words; école x" * 20
    whole = plain_words(text)
    for size in (1, 2, 7, 1 << 20):
        monkeypatch.setattr(importance, "PIECE", size)
        assert [w.decode() for part in importance.word_lists(text) for w in part] == whole
        pairs = [tuple(w.decode() for w in run) for run in importance.runs(text, 2)]
        assert pairs == list(zip(whole, whole[1:], strict=False))


def test_importance_of_nothing(spark, odd_texts):
    docs = documents_of(spark, odd_texts)
    none = docs.limit(0)
    assert importance.resampled(none, docs).count() == 0
    assert rows_of(importance.resampled(docs, none)) == plain_draw(odd_texts, [])


def test_importance_of_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    aim = [r["text"] for r in target.collect()]
    assert rows_of(importance.resampled(docs, target)) == plain_draw(texts, aim)


# --- 12 ---------------------------------------------------------------------------


def plain_negatives(rows):
    usable = []
    for key, vector, label in rows:
        if key is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        ints = [math.floor(256 * float(np.float32(x))) for x in vector]
        usable.append((key, ints, (label + 1) % 10 if key % 7 == 0 else label))
    out = []
    for a, (key, v, label) in enumerate(usable):
        if key % 100:
            continue
        scored = [
            (-sum(x * y for x, y in zip(v, w, strict=False)), other, kind == label)
            for b, (other, w, kind) in enumerate(usable)
            if a != b
        ]
        for negated, positive, _ in sorted(r for r in scored if r[2])[:5]:
            score = -negated
            inside = sorted(r for r in scored if not r[2] and 80 * score <= -100 * r[0] <= 100 * score)
            for rank, (n, negative, _) in enumerate(inside[:5], 1):
                out.append((key, positive, rank, negative, score, -n))
    return sorted(out)


def vectors_of(spark, rows):
    schema = "vec_id bigint, embedding array<float>, label int, at string, id int, kind int"
    return spark.createDataFrame([(*r, "a", 1, 2) for r in rows], schema)


@pytest.fixture(scope="module")
def odd_vectors():
    rng = random.Random(3)
    centres = [[rng.gauss(0, 0.2) for _ in range(8)] for _ in range(3)]
    rows = []
    for i in range(-200, 700):
        centre = centres[i % 3]
        rows.append((i, [c + rng.gauss(0, 0.1) for c in centre], i % 3 if i % 2 else 0))
    rows += [(100, rows[5][1], 1), (100, rows[5][1], 1), (700, [0.0] * 8, 2), (800, [], 0)]
    rows += [(r[0], list(r[1]), r[2]) for r in rows[:60]] + [(900 + i, [0.25] * 8, i % 2) for i in range(120)]
    rows += [(None, [0.1] * 8, 1), (2100, None, 1), (2200, [0.1] * 8, None), (2300, [None] * 8, 1)]
    rows += [(2400, [float("nan")] * 8, 1), (2500, [float("inf")] + [0.0] * 7, 1), (2600, [0.3] * 5, 1)]
    return rows


@pytest.mark.parametrize("size", [2_048, 40])
def test_hard_negatives(spark, odd_vectors, size, monkeypatch):
    """One cell, and many of them: the same rows."""
    monkeypatch.setattr(hard_negatives, "ROWS", size)
    monkeypatch.setattr(hard_negatives, "ANCHORS", size // 8)
    got = hard_negatives.hard_negatives(vectors_of(spark, odd_vectors))
    assert dict(got.dtypes)["rank"] == "int"
    assert rows_of(got) == sorted(plain_negatives(odd_vectors), key=repr)


def test_hard_negatives_of_nothing(spark, odd_vectors):
    assert hard_negatives.hard_negatives(vectors_of(spark, [])).count() == 0
    alone = [r for r in odd_vectors if r[0] is not None and r[0] % 100]
    assert hard_negatives.hard_negatives(vectors_of(spark, alone)).count() == 0


def test_hard_negatives_of_given_table(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in vectors.collect()]
    assert rows_of(hard_negatives.hard_negatives(vectors)) == sorted(plain_negatives(rows), key=repr)


def test_large_scores_are_exact_or_an_error():
    a = np.array([[1 << 27, 3], [-(1 << 27), 5]])
    assert hard_negatives.products(a, a).tolist() == [[(1 << 54) + 9, 15 - (1 << 54)], [15 - (1 << 54), (1 << 54) + 25]]
    with pytest.raises(OverflowError):
        hard_negatives.products(a * 8, a)


def test_key_order():
    rng = random.Random(1)
    keys = [(rng.randrange(3), rng.choice([-5, 0, 5, 1 << 50]), rng.randrange(2), rng.randrange(-9, 9)) for _ in range(500)]
    packed = sorted(hard_negatives.packed(*k) for k in keys)
    assert [hard_negatives.unpacked(k) for k in packed] == sorted(keys, key=lambda k: (k[0], -k[1], k[2], k[3]))


# --- 11 ---------------------------------------------------------------------------


def test_risk_is_the_least_for_the_right_share():
    """With a third of the unlabelled rows toxic, outputs come near the truth."""
    rng = np.random.default_rng(2)
    truth = np.concatenate([np.ones(500, bool), rng.random(3_000) < 1 / 3])
    positive = np.arange(3_500) < 500
    x = (rng.normal(size=(3_500, 4)) + np.where(truth, 1.5, -1.5)[:, None] * [1, 0.5, 0, 0]).astype(np.float32)
    w, b = toxicity.trained(x, positive, 1 / 3, 0)
    slope, offset = toxicity.to_scale(x[positive] @ w + b, x[~positive] @ w + b, 1 / 3)
    p = toxicity.sigmoid(slope * (x[~positive] @ w + b) + offset)
    assert abs(p.mean() - 1 / 3) < 0.05
    assert ((p >= 0.5) == truth[500:]).mean() > 0.9


def marked_rows(n=3_000):
    """Texts of which a tenth hold words of their own, half of these labelled."""
    rng = random.Random(4)
    syllables = ["ka", "lo", "mi", "ter", "an", "su", "re", "ond"]
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 200))]
        toxic = rng.random() < 0.1
        if toxic:
            for _ in range(2 + len(words) // 30):
                words[rng.randrange(len(words))] = "zorg" + rng.choice(syllables)
        rows.append((i, " ".join(words)))
        if rng.random() < 0.5:
            labels.append((i, int(toxic)))
    return rows, labels


def labels_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 0.5) for r in rows], "doc_id bigint, toxic int, quality int, key string, score double")


def test_toxicity(spark, odd_texts):
    rows, labels = marked_rows()
    toxic = {i for i, t in rows if "zorg" in t}
    odd = [(i if i is None or i < 0 else i + 10_000, t) for i, t in odd_texts]
    notes = [*labels, (None, 1), (5, None), (labels[0][0], 0), (99_999, 1)]
    got = toxicity.scored(documents_of(spark, rows + odd), labels_of(spark, notes))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in rows + odd)
    for r in found:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(key.encode()) % 4 == 2)
        assert 0.0 <= r["score"] <= 1.0 and r["predicted"] == int(r["score"] >= 0.3)
    held = {r["doc_id"]: r["predicted"] for r in found if r["held_out"] and r["doc_id"] in range(3_000)}
    right = [p == int(i in toxic) for i, p in held.items()]
    assert sum(right) / len(right) > 0.97
    assert sum(held[i] for i in held if i in toxic) > 0.9 * sum(i in toxic for i in held)
    # Equal texts have equal scores, and a run gives the same again.
    assert len({r["score"] for r in found if r["doc_id"] in (10_001, 10_002)}) == 1
    again = toxicity.scored(documents_of(spark, rows + odd).repartition(3), labels_of(spark, notes[::-1]))
    assert {(r["doc_id"], round(r["score"], 4)) for r in found} == {
        (r["doc_id"], round(r["score"], 4)) for r in again.collect()
    }


def test_held_out_labels_are_not_read(spark):
    rows, labels = marked_rows(600)
    other = [(i, 1 - t) if zlib.crc32(str(i).encode()) % 4 == 2 else (i, t) for i, t in labels]
    docs = documents_of(spark, rows)
    assert rows_of(toxicity.scored(docs, labels_of(spark, labels))) == rows_of(
        toxicity.scored(docs, labels_of(spark, other))
    )


def test_toxicity_without_examples(spark, odd_texts):
    docs = documents_of(spark, odd_texts)
    clean = toxicity.scored(docs, labels_of(spark, [(1, 0), (3, 0)]))
    assert {(r["score"], r["predicted"]) for r in clean.collect()} == {(0.0, 0)}
    assert {r["score"] for r in toxicity.scored(docs, labels_of(spark, [])).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), labels_of(spark, [(1, 1)])).count() == 0
    assert toxicity.scored(docs, labels_of(spark, [(1, 1), (3, 0)])).count() == len(odd_texts)


def test_toxicity_of_given_table(spark):
    """Held-out rows of the given labels, of which some are wrong."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = toxicity.scored(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    held = found.where("held_out").join(labels, "doc_id").groupBy("predicted", "toxic").count().collect()
    n = {(r["predicted"], r["toxic"]): r["count"] for r in held}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.9
    assert n[1, 1] / (n[1, 1] + n.get((0, 1), 0)) > 0.9


def test_feature_densities():
    """Whole words and byte strings inside words, none across texts or words."""
    texts = ["Abcd efghij", "", "École abcdef!abcdef"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    bucket, of, letters = toxicity.feature_buckets(raw, at)
    assert letters.tolist() == [10, 0, 18]
    # 2 words, 1 + 3 of four bytes, 1 of six; then 3 words, 3 + 3 + 3, 1 + 1 + 1.
    assert Counter(of.tolist()) == {0: 2 + 4 + 1, 2: 3 + 9 + 3}
    one = Counter(bucket[of == 2].tolist())
    assert sum(n == 2 for n in one.values()) == 1 + 3 + 1
    same, *_ = toxicity.feature_buckets(np.frombuffer(b"abCD EFGHIJ", np.uint8), np.array([0, 11]))
    assert sorted(same) == sorted(bucket[of == 0])
