"""Predictions against references, losses, and the evaluation report."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplemill.functions.text import clean_prediction
from triplemill.operators.metrics import metrics_by_task


def unmatched(preds: DataFrame, refs: DataFrame, key="id") -> DataFrame:
    """Counts of predictions without a reference and the other way round."""
    sides = preds.select(key, F.lit(1).alias("side")).unionByName(
        refs.select(key, F.lit(2).alias("side"))
    )
    found = sides.groupBy(key).agg(
        F.count_if(F.col("side") == 1).alias("p"), F.count_if(F.col("side") == 2).alias("r")
    )
    return found.agg(
        F.count_if(F.col("r") == 0).alias("without_reference"),
        F.count_if(F.col("p") == 0).alias("without_prediction"),
        F.count_if((F.col("p") > 1) | (F.col("r") > 1)).alias("repeated"),
    )


def align(preds: DataFrame, refs: DataFrame, key="id", check=True) -> DataFrame:
    """Join ``(id, pred)`` to references; an unmatched or repeated row is an error."""
    if check:
        bad = unmatched(preds, refs, key).first().asDict()
        if any(bad.values()):
            raise ValueError(f"predictions and references do not match: {bad}")
    return refs.join(preds.select(key, "pred"), key)


def cleaned(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: clean_prediction(F.col(c)) for c in ("pred", "ref")})


def predict(rows: DataFrame, function, schema="id string, pred string") -> DataFrame:
    """Predictions of a caller's function over batches of ``(id, input)``."""
    return rows.select("id", "input").mapInPandas(function, schema)


def epoch_means(log: DataFrame, by=("epoch",)) -> DataFrame:
    """Unweighted mean over batches of each metric, over those that report it."""
    return log.where("value is not null").groupBy(*by, "metric").agg(F.avg("value").alias("value"))


def task_losses(batches: DataFrame, by=("split", "task")) -> DataFrame:
    """Mean batch loss and number of samples of each task."""
    return batches.groupBy(*by).agg(
        F.avg("loss").alias("loss"), F.sum("n").cast("bigint").alias("num_samples")
    )


def split_losses(tasks: DataFrame, by=("split",)) -> DataFrame:
    """Sample-weighted mean of the task losses of a split."""
    weighted = F.sum(F.col("loss") * F.col("num_samples"))
    return tasks.groupBy(*by).agg(
        F.try_divide(weighted, F.sum("num_samples")).alias("avg_loss"),
        F.sum("num_samples").cast("bigint").alias("num_samples"),
    )


def report_rows(scores: DataFrame, losses: DataFrame) -> DataFrame:
    """Long report ``(split, task, inner, metric, value)``.

    ``scores`` comes from metrics per ``(split, task, inner)``, ``losses`` from
    ``task_losses``. Split totals have no task, task totals no inner task.
    """
    none = F.lit(None).cast("string")
    per_task = losses.unpivot(
        ["split", "task"],
        [F.col("loss"), F.col("num_samples").cast("double").alias("num_samples")],
        "metric",
        "value",
    ).select("split", "task", none.alias("inner"), "metric", "value")
    totals = split_losses(losses)
    per_split = totals.unpivot(
        ["split"],
        [F.col("avg_loss"), F.col("num_samples").cast("double").alias("num_samples")],
        "metric",
        "value",
    ).select("split", none.alias("task"), none.alias("inner"), "metric", "value")
    inner = scores.select("split", "task", "inner", "metric", "value")
    return inner.unionByName(per_task).unionByName(per_split)


def flatten_report(rows: DataFrame) -> DataFrame:
    """``(key, value)`` with keys ``split/task/inner/metric``. Sample totals of
    a split or task have no key of their own."""
    kept = rows.where("metric <> 'num_samples'")
    return kept.select(F.concat_ws("/", "split", "task", "inner", "metric").alias("key"), "value")


def report_json(rows: DataFrame) -> DataFrame:
    """The report as one nested JSON text, of all tasks that have losses or scores.
    A task without losses has no ``loss`` and as many samples as were scored. The
    text is as long as the metric names, tasks and splits, not the data."""
    is_total = F.col("task").isNull()
    is_task = F.col("task").isNotNull() & F.col("inner").isNull()
    inner = (
        rows.where("inner is not null")
        .groupBy("split", "task", "inner")
        .agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("m"))
        .groupBy("split", "task")
        .agg(
            F.map_from_arrays(F.collect_list("inner"), F.collect_list("m")).alias("metrics"),
            F.sum(F.col("m")["samples"]).cast("bigint").alias("scored"),
        )
    )
    tasks = (
        rows.where(is_task)
        .groupBy("split", "task")
        .agg(
            F.max(F.when(F.col("metric") == "loss", F.col("value"))).alias("loss"),
            F.max(F.when(F.col("metric") == "num_samples", F.col("value"))).cast("bigint").alias("num_samples"),
        )
        .join(inner, ["split", "task"], "full")
        .withColumn("num_samples", F.coalesce("num_samples", "scored"))
        # A task without scored rows still says how many it has.
        .withColumn(
            "metrics",
            F.coalesce(
                "metrics",
                F.create_map(
                    "task", F.create_map(F.lit("samples"), F.col("num_samples").cast("double"))
                ),
            ),
        )
        .groupBy("split")
        .agg(
            F.map_from_arrays(
                F.collect_list("task"),
                F.collect_list(F.struct("loss", "num_samples", "metrics")),
            ).alias("tasks")
        )
    )
    totals = (
        rows.where(is_total)
        .groupBy("split")
        .agg(
            F.max(F.when(F.col("metric") == "avg_loss", F.col("value"))).alias("avg_loss"),
            F.max(F.when(F.col("metric") == "num_samples", F.col("value"))).cast("bigint").alias("num_samples"),
        )
    )
    whole = totals.join(tasks, "split", "full").agg(
        F.map_from_arrays(
            F.collect_list("split"),
            F.collect_list(F.struct("tasks", "avg_loss", "num_samples")),
        ).alias("splits")
    )
    return whole.select(F.to_json(F.struct("splits")).alias("report"))


def evaluation(rows: DataFrame, batches: DataFrame, dataset: str = "task") -> DataFrame:
    """Report of ``(split, task, id, pred, ref)`` and a log of batch losses.

    ``dataset`` names the column that says for which configured task a row was
    read. The outer level of the report and the losses go by it; metrics go by
    the ``task`` each row is tagged with, within its data set.
    """
    tagged = cleaned(rows).withColumn("_dataset", F.col(dataset))
    scores = metrics_by_task(tagged, ("split", "_dataset", "task")).select(
        "split", F.col("_dataset").alias("task"), F.col("task").alias("inner"), "metric", "value"
    )
    return report_rows(scores, task_losses(batches))
