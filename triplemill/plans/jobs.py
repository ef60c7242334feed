"""Whole jobs: from raw records to datasets, subsets, vocabularies, reports."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplemill import constants as C
from triplemill.operators import extract, pairing, ranking, report, subset, tasks, vocab
from triplemill.plans.publish import published
from triplemill.plans.scratch import dropped, written
from triplemill.sources import jsonl

# Triples of an entity that one row may hold: with 300 bytes each, half of what a
# value can.
LONG_ROWS = 3_000_000


def build_dataset(
    raw_triples: DataFrame,
    raw_texts: DataFrame,
    out: str,
    min_triples: int = C.MIN_TRIPLES,
    ratios=C.SPLIT_RATIOS,
    seed: int = C.SPLIT_SEED,
    deduplicate: bool = True,
    normalize_prefixes: bool = False,
    max_tokens: int | None = None,
    emit_tasks: bool = True,
    long_rows: int = LONG_ROWS,
) -> DataFrame:
    """Write pairs, the audit of the pairing, split lists and task examples
    under ``out``, together when all are done.

    The pairs are made once and kept as a table, and the audit is observed on the
    way; the split is a comparison of hashes with two cuts, so nothing is joined to
    apply it.

    Pairs are rows of whole entities. Those of entities with more than ``long_rows``
    triples, which one value could not hold, are written as ``pairs_in_parts`` and
    ``tasks_in_parts``: rows of ``part`` 0, 1 ... that are to be put end to end. They
    are in the split lists and the audit; the pairs returned are the others.
    """
    spark = raw_triples.sparkSession
    if normalize_prefixes:
        raw_triples = pairing.compact_columns(raw_triples, "film", "p", "o")
        raw_texts = pairing.compact_columns(raw_texts, "film")
    triples = pairing.directed(raw_triples)
    with dropped(spark), published(spark, out) as stage:
        made = pairing.audited_records(
            triples, raw_texts, min_triples, deduplicate=deduplicate, long_rows=long_rows
        )
        pairs = written(made.pairs)
        made.audit().write.json(f"{stage}/audit")
        films = pairs.select("film")
        long = None if made.long is None else written(made.long)
        if long is not None:
            films = films.unionByName(long.select("film").distinct())
        cuts = ranking.split_cuts(films, ratios=ratios, seed=seed)
        split = ranking.split_of("film", cuts, seed)
        pairs = pairs.withColumn("split", split)
        jsonl.write_pairs(pairs, f"{stage}/pairs")
        jsonl.write_split_lists(films.withColumn("split", split), f"{stage}/splits")
        if emit_tasks:
            jsonl.write_tasks(
                tasks.task_examples(pairs, seed=seed, max_tokens=max_tokens), f"{stage}/tasks"
            )
        if long is not None:
            part_rows = min(long_rows, ranking.CHUNK)
            parts = pairing.pair_parts(long, part_rows).withColumn("split", split)
            jsonl.write_pairs(parts, f"{stage}/pairs_in_parts")
            if emit_tasks:
                pieces = tasks.task_parts(
                    long, seed=seed, max_tokens=max_tokens, part_rows=part_rows
                )
                jsonl.write_tasks(pieces.withColumn("split", split), f"{stage}/tasks_in_parts")
    return jsonl.read_pairs(spark, f"{out}/pairs")


def read_tasks(spark: SparkSession, out: str) -> DataFrame:
    return jsonl.read_jsonl(
        spark, f"{out}/tasks", "film string, input string, target string, task string, split string"
    )


def build_subset(
    pairs: DataFrame, examples: DataFrame, out: str, total=subset.SUBSET_SIZE, source: str = ""
):
    """Write the examples of an even subset, its entities, and its manifest, which
    names the ``source`` the subset was made from."""
    spark = pairs.sparkSession
    with dropped(spark), published(spark, out) as stage:
        chosen = written(subset.select_subset(pairs.select("film", "split", "n_triples"), total))
        kept = written(subset.subset_examples(examples, chosen))
        jsonl.write_tasks(kept, f"{stage}/tasks")
        jsonl.write_jsonl(chosen, f"{stage}/entities")
        counts = subset.subset_counts(kept)
        subset.manifest_json(chosen, counts, source).write.text(f"{stage}/manifest")
    return jsonl.read_jsonl(spark, f"{out}/entities", "split string, film string, n_triples int")


def train_vocabulary(docs: DataFrame, out: str, vocab_size=C.VOCAB_SIZE, min_freq=C.MIN_FREQUENCY):
    """Learn a vocabulary from ``text`` and write its tokens and merges."""
    spark = docs.sparkSession
    with dropped(spark), published(spark, out) as stage:
        words = written(vocab.pretoken_counts(docs))
        tokens, merges = vocab.learn_merges(words, vocab_size, min_freq)
        vocab.token_table(spark, tokens).write.json(f"{stage}/tokens")
        vocab.merge_table(spark, merges).write.json(f"{stage}/merges")
    return tokens, merges


def load_vocabulary(spark: SparkSession, out: str):
    return vocab.read_vocabulary(
        jsonl.read_jsonl(spark, f"{out}/tokens", "token string, id int"),
        jsonl.read_jsonl(
            spark, f"{out}/merges", "rank int, left string, right string, merged string, count bigint"
        ),
    )


def collect_texts(
    raw_triples: DataFrame,
    responses: DataFrame,
    cache_path: str,
    out: str,
    most: int | None = None,
) -> DataFrame:
    """Resume the collection of texts from responses ``(film, text, status, url)``.

    New texts are appended to the cache, failures and the texts of all wanted
    entities are written, and the coverage is returned.
    """
    spark = raw_triples.sparkSession
    with dropped(spark), published(spark, out) as stage:
        films = written(extract.first_seen(raw_triples, most))
        cache = written(jsonl.read_cache(spark, cache_path))
        todo = extract.to_fetch(films, cache)
        # Repeated responses count once.
        answers = extract.requested(responses, todo).groupBy("film").agg(F.max("text").alias("text"))
        found = written(answers)
        jsonl.write_jsonl(found, cache_path, append=True)
        jsonl.write_jsonl(extract.failed(todo, found, responses), f"{stage}/failures")
        merged = extract.merge_texts(cache, found)
        jsonl.write_jsonl(extract.requested(merged, films), f"{stage}/texts")
        counts = extract.coverage(films, cache, found)
        row, schema = counts.first(), counts.schema
    return spark.createDataFrame([row], schema)


def evaluate(rows: DataFrame, batches: DataFrame, out: str) -> DataFrame:
    """Score predictions and write the report, long and as one JSON text."""
    spark = rows.sparkSession
    with dropped(spark), published(spark, out) as stage:
        rep = written(report.evaluation(rows, batches))
        rep.write.parquet(f"{stage}/rows")
        report.report_json(rep).write.text(f"{stage}/json")
    return spark.read.parquet(f"{out}/rows")
