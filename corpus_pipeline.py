"""From raw documents to a mixed training set, one operator a stage.

Each stage works on what the one before kept; all but the last return the columns
of ``documents``. A document is known by its id and its text, so a decision on one
concerns no other, even where ids are null or repeat. Rows with the same id and text
are judged alike; near-dedup keeps one of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplemill.llm import decontamination, line_dedup, mixing, quality, simhash
from triplemill.llm.common import read
from triplemill.plans.scratch import written

ROW = "_row"


def _known(docs: DataFrame) -> DataFrame:
    """Documents with what they are known by: ``row``, a null id last."""
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", mark.alias("mark"))
    return docs.withColumn(ROW, row)


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Documents that are not among ``rows`` (their ``row`` column)."""
    gone = rows.select(*(F.col(ROW)[name].alias(f"its_{name}") for name in ("doc_id", "mark"))).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("its_doc_id")) & (F.col(f"{ROW}.mark") == F.col("its_mark"))
    return docs.join(gone, same, "left_anti").drop(ROW)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers."""
    known = _known(docs)
    return _without(known, quality.judged(known, ROW).where("not kept"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of lines that an earlier one has."""
    done = line_dedup.deduplicated(docs)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates."""
    known = _known(docs)
    groups = written(simhash.near_texts(known, ROW))
    kept = _without(known, groups.where(f"{ROW} <> component_id"))
    equal = groups.groupBy(ROW).agg(F.count("*").alias("n")).where("n > 1")
    return kept if equal.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    known = _known(docs)
    return _without(known, decontamination.contaminated(known, read(spark, sf_dir, "benchmark"), ROW))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of the documents, by output shard and place in it."""
    return mixing.mixed_texts(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_deduplication),
    ("simhash near-dedup", near_deduplication),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mixing),
]

# Fitted covariances, fingerprints and draws are beyond one SQL text.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
