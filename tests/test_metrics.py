"""Scores with exact values, and against plain Python."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from checks import scores
from triplemill.operators import metrics, report

TEXTS = "id string, pred string, ref string"


def frame(spark, rows, schema=TEXTS):
    return spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], schema)


def score(df):
    return df.first()[0]


def test_identity(spark):
    df = frame(spark, [("the cat is on the mat",) * 2])
    assert score(metrics.corpus_bleu(df)) == pytest.approx(100)
    assert score(metrics.rouge_l(df)) == pytest.approx(100)
    assert score(metrics.meteor(df)) == pytest.approx(100 * (1 - 0.5 / 216))


def test_partial(spark):
    df = frame(spark, [("the cat sat on the mat", "the cat is on the mat")])
    logs = [math.log((m + 1e-9) / (t + 1e-9)) for m, t in ((5, 6), (3, 5), (1, 4), (0, 3))]
    assert score(metrics.corpus_bleu(df)) == pytest.approx(100 * math.exp(sum(logs) / 4))
    assert score(metrics.rouge_l(df)) == pytest.approx(100 * 5 / 6)


def test_meteor_ignores_case(spark):
    df = frame(spark, [("The quick brown fox", "the quick fox")])
    mean = 0.75 / (0.9 * 0.75 + 0.1)
    assert score(metrics.meteor(df)) == pytest.approx(100 * mean * (1 - 0.5 / 27))


def test_empty_sides(spark):
    df = frame(spark, [("", "a b"), ("a b", ""), ("", "")])
    assert [score(m(df)) for m in (metrics.corpus_bleu, metrics.rouge_l, metrics.meteor)] == [0, 0, 0]
    none = df.where("id = 'x'")
    assert [score(m(none)) for m in (metrics.corpus_bleu, metrics.rouge_l, metrics.meteor, metrics.accuracy)] == [0] * 4


def test_short_texts_have_no_bleu(spark):
    assert score(metrics.corpus_bleu(frame(spark, [("a b", "a b")]))) == 0


def plain_bleu(rows):
    m, t, pl, rl = [0] * 4, [0] * 4, 0, 0
    for pred, refs in rows:
        p, rs = pred.split(), [r.split() for r in refs]
        pl += len(p)
        rl += min(((abs(len(r) - len(p)), len(r)) for r in rs), default=(0, 0))[1]
        for n in range(1, 5):
            def grams(w):
                return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            most = Counter()
            for r in rs:
                most |= grams(r)
            m[n - 1] += sum((grams(p) & most).values())
            t[n - 1] += max(0, len(p) - n + 1)
    if 0 in t:
        return 0.0
    mean = math.exp(sum(math.log((a + 1e-9) / (b + 1e-9)) for a, b in zip(m, t)) / 4)
    return 100 * mean * (math.exp(1 - rl / pl) if pl < rl else 1)


def test_bleu_with_any_number_of_references(spark):
    rng = random.Random(6)
    def words():
        return " ".join(rng.choices("abcd", k=rng.randint(0, 12)))
    rows = [(words(), [words() for _ in range(rng.randint(0, 3))]) for _ in range(150)]
    df = frame(spark, rows, "id string, pred string, ref array<string>")
    assert score(metrics.corpus_bleu(df)) == pytest.approx(plain_bleu(rows))
    single = [(p, (r or [""])[0]) for p, r in rows]
    got = score(metrics.corpus_bleu(frame(spark, single)))
    assert got == pytest.approx(plain_bleu([(p, [r]) for p, r in single]))


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def plain_meteor(pred, ref):
    need, places = Counter(pred.lower().split()), []
    for i, w in enumerate(ref.lower().split()):
        if need[w]:
            need[w] -= 1
            places.append(i)
    if not places:
        return 0.0
    m = len(places)
    chunks = 1 + sum(b != a + 1 for a, b in zip(places, places[1:]))
    p, r = m / len(pred.split()), m / len(ref.split())
    return (1 - 0.5 * (chunks / m) ** 3) * p * r / (0.9 * p + 0.1 * r)


def test_rows_against_plain_python(spark):
    rng = random.Random(7)
    def words():
        return " ".join(rng.choices("aAbcdé", k=rng.randint(0, 15)))
    rows = [(words(), words()) for _ in range(300)]
    df = metrics.with_rouge(frame(spark, rows))
    got = df.select("pred", "ref", "rouge", metrics.meteor_row(F.col("pred"), F.col("ref")).alias("m"))
    for r in got.collect():
        p, q = r["pred"].split(), r["ref"].split()
        n = plain_lcs(p, q)
        want = 0.0
        if n:
            pr, rc = n / len(p), n / len(q)
            want = 2.44 * pr * rc / (rc + 1.44 * pr)
        assert r["rouge"] == pytest.approx(want)
        assert r["m"] == pytest.approx(plain_meteor(r["pred"], r["ref"]))


def test_long_texts_are_scored_whole(spark):
    rng = random.Random(8)
    a, b = (" ".join(rng.choices([f"w{i}" for i in range(50)], k=3000)) for _ in "ab")
    df = frame(spark, [(a, b)])
    n = plain_lcs(a.split(), b.split())
    assert score(metrics.rouge_l(df)) == pytest.approx(100 * n / 3000)
    assert score(metrics.meteor(df)) == pytest.approx(100 * plain_meteor(a, b))


TRIPLE = "<SOT> <SUBJ> {} <PRED> {} <OBJ> {} <EOT>"


def test_triples(spark):
    right, wrong = TRIPLE.format("a", "b", "c"), TRIPLE.format("a", "d", "e")
    df = frame(spark, [(f"{right} {wrong} {right}", right)])
    for got in (metrics.triple_scores(df), metrics.membership_scores(metrics.triple_sets(df))):
        r = got.first()
        assert (r["precision"], r["recall"]) == (50, 100)
        assert r["f1"] == pytest.approx(200 / 3)
    nothing = metrics.triple_scores(frame(spark, [("", "")])).first()
    assert (nothing["precision"], nothing["recall"], nothing["f1"]) == (0, 0, 0)


def test_triples_as_lists(spark):
    df = frame(
        spark,
        [([["a", "b", "c d"], ["x"]], [["a", "b", "c d"], ["a", "b", "c"]])],
        "id string, pred array<array<string>>, ref array<array<string>>",
    )
    r = metrics.membership_scores(metrics.triple_sets(df)).first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 0, 1)


def test_accuracy(spark):
    df = frame(spark, [("entity", " entity\n"), ("wrong", "gold"), (None, ""), (None, "x")])
    assert score(metrics.accuracy(df)) == 50


def test_metrics_go_by_task(spark):
    one = TRIPLE.format("a", "b", "c")
    rows = [
        ("val", "text2rdf", one, one),
        ("val", "rdfcomp2", "x", one),
        ("val", "rdfcomp1", "a", "a"),
        ("val", "rdf2text", "a b c d", "a b c d"),
        ("val", "other", "a b c d", "a b c d"),
    ]
    df = frame(spark, rows, "id string, split string, task string, pred string, ref string")
    got = {(r["task"], r["metric"]): r["value"] for r in metrics.metrics_by_task(df).collect()}
    kinds = {"text2rdf": {"precision", "recall", "f1"}, "rdfcomp1": {"accuracy"}, "rdf2text": {"bleu", "rouge_l", "meteor"}}
    kinds["rdfcomp2"], kinds["other"] = kinds["text2rdf"], kinds["rdf2text"]
    assert set(got) == {(t, m) for t, ms in kinds.items() for m in ms | {"samples"}}
    assert got["text2rdf", "f1"] == 100 and got["rdfcomp2", "f1"] == 0
    assert got["rdfcomp1", "accuracy"] == 100 and got["other", "bleu"] == pytest.approx(100)


SPANS = "pred_ids array<int>, labels array<int>, spans array<struct<start:int,len:int>>"


def spans(spark, *rows):
    return metrics.span_accuracy(spark.createDataFrame(list(rows), SPANS)).first()["mask_accuracy"]


def test_span_accuracy(spark):
    assert spans(spark, ([3], [5, 3], [(0, 1)])) == 1
    assert spans(spark, ([4], [9, 2], [(0, 1)])) == 0
    # outside, empty, negative and padded spans do not count
    assert spans(spark, ([1, 2, 0], [1, 2, 0], [(0, 2), (2, 1), (2, 2), (5, 1), (-1, 1), (0, 0)])) == 1
    assert spans(spark, ([1], [0], [(0, 1)])) is None
    with pytest.raises(Exception, match="one longer"):
        spans(spark, ([1], [1, 2, 3], [(0, 1)]))


def test_losses(spark):
    log = spark.createDataFrame(
        [("val", "a", 0, 1.0, 10), ("val", "a", 1, 3.0, 2), ("val", "b", 0, 5.0, 4)],
        "split string, task string, batch int, loss double, n int",
    )
    per_task = report.task_losses(log)
    assert {r["task"]: r["loss"] for r in per_task.collect()} == {"a": 2.0, "b": 5.0}
    total = report.split_losses(per_task).first()
    assert total["avg_loss"] == pytest.approx((2 * 12 + 5 * 4) / 16) and total["num_samples"] == 16


def test_unequal_sides_are_an_error(spark):
    preds = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, pred string")
    refs = spark.createDataFrame([("1", "a")], "id string, ref string")
    with pytest.raises(ValueError):
        report.align(preds, refs)
    assert report.align(preds.where("id = '1'"), refs).count() == 1


def test_predictions_of_a_function(spark):
    df = spark.createDataFrame([("1", "a b"), ("2", "c")], "id string, input string")
    def upper(batches):
        for b in batches:
            b["pred"] = b["input"].str.upper()
            yield b[["id", "pred"]]
    assert {r["id"]: r["pred"] for r in report.predict(df, upper).collect()} == {"1": "A B", "2": "C"}


def test_row_scores_need_no_shuffle_of_texts(spark, sf):
    from checks.scores import pred_ref

    plan = metrics.metrics_by_task(pred_ref(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # of the sums


def test_report_tells_data_set_from_task(spark):
    """A data set of mixed tags: losses by data set, metrics by the tag inside."""
    rows = spark.createDataFrame(
        [
            ("val", "all", "text2rdf", "1", "<SOT> <SUBJ> a <PRED> b <OBJ> c <EOT>", "<SOT> <SUBJ> a <PRED> b <OBJ> c <EOT>"),
            ("val", "all", "rdfcomp1", "2", "x", "y"),
            ("val", "all", "rdfcomp1", "3", "y", "y"),
            ("val", "one", "rdfcomp1", "4", "y", "y"),
        ],
        "split string, dataset string, task string, id string, pred string, ref string",
    )
    log = spark.createDataFrame(
        [("val", "all", 2.0, 3), ("val", "one", 1.0, 1), ("val", "bare", 4.0, 2)],
        "split string, task string, loss double, n int",
    )
    rep = report.evaluation(rows, log, "dataset")
    got = {r["key"]: r["value"] for r in report.flatten_report(rep).collect()}
    assert got["val/all/text2rdf/f1"] == 100 and got["val/all/text2rdf/samples"] == 1
    assert got["val/all/rdfcomp1/accuracy"] == 50 and got["val/one/rdfcomp1/accuracy"] == 100
    assert got["val/all/loss"] == 2 and "val/text2rdf/loss" not in got
    tasks = json.loads(report.report_json(rep).first()[0])["splits"]["val"]["tasks"]
    assert tasks["all"]["metrics"]["rdfcomp1"] == {"accuracy": 50.0, "samples": 2.0}
    assert tasks["bare"]["metrics"] == {"bare": {"samples": 2.0}}


def test_report_of_scored_tasks_without_losses(spark):
    rows = spark.createDataFrame(
        [("val", t, f"{t}{i}", "a b", "a b") for t in ("rdf2text", "rdfcomp1") for i in range(3)],
        "split string, task string, id string, pred string, ref string",
    )
    batches = spark.createDataFrame([("val", "rdf2text", 0.5, 9), ("test", "rdf2text", 1.5, 4)], "split string, task string, loss double, n bigint")
    splits = json.loads(report.report_json(report.evaluation(rows, batches)).first()[0])["splits"]
    tasks = splits["val"]["tasks"]
    assert tasks["rdf2text"]["num_samples"] == 9 and tasks["rdf2text"]["loss"] == 0.5
    assert tasks["rdfcomp1"]["num_samples"] == 3 and "loss" not in tasks["rdfcomp1"]
    assert tasks["rdfcomp1"]["metrics"]["rdfcomp1"]["accuracy"] == 100.0
    assert splits["val"]["avg_loss"] == 0.5 and list(splits["test"]["tasks"]) == ["rdf2text"]
    none = json.loads(report.report_json(report.evaluation(rows, batches.limit(0))).first()[0])["splits"]
    assert set(none["val"]["tasks"]) == {"rdf2text", "rdfcomp1"} and "avg_loss" not in none["val"]


def test_both_sides_come_from_one_layout(spark, sf):
    long = scores.sides(spark, sf)
    for df in (metrics.triple_membership(long), metrics.triple_sets(scores.lines(spark, sf))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1
