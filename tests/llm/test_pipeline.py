"""The pipeline stage by stage, on documents with null and repeated ids, and whole on a
given table."""

import collections
import random

import pytest

import corpus_pipeline as pipeline
from triplemill.llm import decontamination, mixing, quality, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(4, 9))) for _ in range(n))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)
    path = str(tmp_path_factory.mktemp("odd"))
    items = [words(rng, 20), words(rng, 30)]
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    texts = [words(rng, 120) for _ in range(60)]
    near = texts[0].split()
    near[50] = "other"
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, t) for t in texts[:3]] + [(None, words(rng, 90)) for _ in range(4)]
    rows += [(7, words(rng, 80)), (7, texts[7]), (7, texts[7])]
    rows += [(100, " ".join(near)), (101, items[0] + " " + words(rng, 60)), (None, words(rng, 70) + " " + items[1])]
    rows += [(102, None), (103, ""), (None, None), (104, words(rng, 10)), (8, "# $ % " * 40 + words(rng, 60))]
    docs = [(i, t, "en", "s%d" % (len(t or "") % 3), len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    judged = collections.Counter()
    kept = pipeline.quality_rules(spark, docs, folder)
    assert kept.columns == names
    for r in quality.judged(docs.withColumn("key", docs["text"]), "key").collect():
        judged[r["key"]] += r["kept"]
    assert collections.Counter(r["text"] for r in kept.collect()) == +judged
    # Other rows with the id of a rejected one stay.
    assert {(8, True), (None, True)} <= {(r["doc_id"], len(r["text"].split()) > 50) for r in kept.collect()}

    kept = kept.cache()
    once = pipeline.near_deduplication(spark, kept, folder)
    assert once.columns == names
    groups = collections.defaultdict(list)
    marked = kept.withColumn("key", kept["text"])
    for r in simhash.near_texts(marked, "key").distinct().collect():
        groups[r["component_id"]].append(r["key"])
    own = [r["text"] for r in once.collect()]
    assert len(own) == len(groups) and all(sum(t in own for t in g) == 1 for g in groups.values())
    assert sum(len(g) > 1 for g in groups.values()) >= 1
    ids = collections.defaultdict(list)
    for r in kept.collect():
        ids[r["text"]].append(r["doc_id"])
    by_text = {r["text"]: r["doc_id"] for r in once.collect()}
    for g in groups.values():
        known = [i for t in g for i in ids[t] if i is not None]
        chosen = next(by_text[t] for t in g if t in by_text)
        assert chosen == (min(known) if known else None)

    clean = pipeline.benchmark_decontamination(spark, docs, folder)
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    leaks = {r["key"] for r in decontamination.contaminated(docs.withColumn("key", docs["text"]), bench, "key").collect()}
    assert len(leaks) == 2
    assert rows_of(clean) == rows_of(docs.where(~docs["text"].isin(*leaks) | docs["text"].isNull()))

    lines = pipeline.line_deduplication(spark, docs, folder)
    assert lines.columns == names and lines.count() == docs.count()
    mixed = pipeline.source_mixing(spark, docs, folder)
    assert rows_of(mixed) == rows_of(mixing.mixed_texts(docs))


def test_empty_documents(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_run_applies_the_stages_in_turn(spark, sf):
    docs = pipeline.read(spark, sf, "documents")
    for name, stage in pipeline.STAGES:
        done = pipeline.written(stage(spark, docs, sf))
        if name != "mixing sources":
            assert done.columns == docs.columns and done.count() <= docs.count()
        docs = done
    assert rows_of(pipeline.run(spark, sf)) == rows_of(docs)
