"""JSON-lines sources and sinks (plain or compressed by file suffix)."""

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triplemill.functions.text import infer_task, present
from triplemill.plans.scratch import written

RAW_TRIPLES = "film string, dir string, p string, o string"
RAW_TEXTS = "film string, text string"
PAIRS = "film string, text string, triples array<array<string>>, n_triples int"
EXAMPLES = "id string, task string, film string, input string, target string"
FAILURES = "film string, title string, status int, url string"


def read_jsonl(
    spark: SparkSession, path, schema: str, arrival: bool = False, nested: bool = False
) -> DataFrame:
    """Read records; blank lines are skipped, a malformed line is an error.

    ``arrival`` adds ``seq``, which orders records as they came: by the append that
    wrote the file (files of other writers first), then by the time it was written,
    by file and by place in it. ``nested`` reads the folders of appends, too.
    """
    return _read(spark, path, schema, "FAILFAST", arrival, nested)


def read_tolerant(
    spark: SparkSession, path, schema: str, arrival: bool = False, nested: bool = False
) -> DataFrame:
    """Read records and leave malformed lines out."""
    return _read(spark, path, schema, "DROPMALFORMED", arrival, nested)


def _read(spark, path, schema, mode, arrival, nested):
    reader = spark.read.schema(schema).option("mode", mode)
    df = (reader.option("recursiveFileLookup", "true") if nested else reader).json(path)
    if not arrival:
        return df
    name = F.col("_metadata.file_path")
    append = F.nullif(F.regexp_extract(name, APPENDED, 1), F.lit("")).cast("bigint")
    return df.withColumn(
        "seq",
        F.struct(
            F.coalesce(append, F.lit(0)).alias("append"),
            F.col("_metadata.file_modification_time").alias("time"),
            name.alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ),
    )


APPENDED = r"/append-(\d+)/[^/]*$"


def append_folder(path: str) -> str:
    """Folder of the next append under ``path``. Its number is the time in
    nanoseconds, so that appends are ordered by their names, not by what a store
    keeps of the times of files."""
    return f"{path.rstrip('/')}/append-{time.time_ns():020d}"


def write_jsonl(df: DataFrame, path: str, by=(), append=False, compression=None) -> None:
    """Write records as JSON lines, with NULL fields, in a folder per ``by``; an
    ``append`` is a folder of its own beside what is there."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", "false")
    if compression:
        writer = writer.option("compression", compression)
    if by:
        writer = writer.partitionBy(*by)
    writer.json(append_folder(path) if append else path)


def numbered(records: DataFrame, name="line") -> DataFrame:
    """Number of each record in its file, from 0, however many tasks read it.

    ``seq`` of ``read_jsonl`` has a rising number within each block that was read.
    Only blocks are counted and put in order; the records are written once, so that
    both passes see the same numbers, and are not shuffled: the table of blocks is
    joined, which Spark broadcasts while it is small.
    """
    laid = written(records)
    blocks = laid.groupBy(
        F.col("seq.file").alias("_file"), F.col("seq.block").alias("_block")
    ).agg(F.count("*").alias("_n"), F.min("seq.row").alias("_first"))
    before = Window.partitionBy("_file").orderBy("_block")
    shifts = blocks.select(
        "_file", "_block", (F.sum("_n").over(before) - F.col("_n") - F.col("_first")).alias("_shift")
    )
    same = (F.col("seq.file") == F.col("_file")) & (F.col("seq.block") == F.col("_block"))
    return (
        laid.join(shifts, same)
        .withColumn(name, F.col("seq.row") + F.col("_shift"))
        .drop("_file", "_block", "_shift")
    )


def read_examples(
    spark: SparkSession, path, arrival: bool = True, nested: bool = False
) -> DataFrame:
    """Task examples with defaults: id from id, entity or line number, empty
    texts for missing ones, task from its field, file name or input."""
    df = numbered(read_jsonl(spark, path, EXAMPLES, arrival=True, nested=nested), "_line")
    out = with_defaults(df, F.col("_line").cast("string"), F.col("seq.file")).drop("_line")
    return out if arrival else out.drop("seq")


def with_defaults(df: DataFrame, line, file_name) -> DataFrame:
    """Fill the defaults of task examples from a line number and a file name."""

    def some(name):
        return F.when(present(F.col(name)), F.col(name))

    return df.withColumns(
        {
            "id": F.coalesce(some("id"), some("film"), line),
            "task": F.coalesce(some("task"), infer_task(file_name, F.col("input"))),
            "input": F.coalesce("input", F.lit("")),
            "target": F.coalesce("target", F.lit("")),
        }
    )


def corpus(examples: DataFrame, splits=None) -> DataFrame:
    """Input and target of every example as documents of their own.

    Without ``splits`` the held-out splits are part of the corpus, too.
    """
    if splits is not None:
        examples = examples.where(F.col("split").isin(*splits))
    sides = F.array(F.coalesce("input", F.lit("")), F.coalesce("target", F.lit("")))
    return examples.select(F.explode(sides).alias("text"))


def read_corpus(spark: SparkSession, pattern) -> DataFrame:
    """Documents of all example files that match a pattern of one folder."""
    return corpus(read_jsonl(spark, pattern, "input string, target string"))


def read_cache(spark: SparkSession, path) -> DataFrame:
    """Last usable text per entity of a cache that may hold broken lines; a cache
    that is not there yet is empty."""
    try:
        records = read_tolerant(spark, path, RAW_TEXTS, arrival=True, nested=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RAW_TEXTS)
    return last_cached(records)


def last_cached(records: DataFrame) -> DataFrame:
    return (
        records.where(present(F.col("film")) & present(F.col("text")))
        .groupBy("film")
        .agg(F.max_by("text", F.struct("seq", "text")).alias("text"))
    )


def write_tasks(examples: DataFrame, path: str) -> None:
    """Task examples in a folder per task and split; pieces with their ``part``."""
    part = [c for c in ("part",) if c in examples.columns]
    names = ["task", "split", "film", *part, "input", "target"]
    write_jsonl(examples.select(*names), path, ("task", "split"))


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Canonical pairs in a folder per split, triples as three-element lists; those
    of long entities have a row per ``part``."""
    lists = F.transform("triples", lambda t: F.array(t["s"], t["p"], t["o"]))
    write_jsonl(pairs.withColumn("triples", lists), path, ("split",))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs with their split, triples as records again."""
    names = ("s", "p", "o")
    triple = F.transform(
        "triples", lambda t: F.struct(*(F.get(t, F.lit(i)).alias(n) for i, n in enumerate(names)))
    )
    return read_jsonl(spark, path, PAIRS + ", split string").withColumn("triples", triple)


def write_split_lists(pairs: DataFrame, path: str) -> None:
    """Entities per split, one line each: the list of a split grows with the
    data, so it is a folder of lines and not one JSON value."""
    write_jsonl(pairs.select("film", "split"), path, ("split",))
