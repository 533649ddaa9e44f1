"""From raw predictions to reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.functions import scoring
from sieveworks.operators import reports
from sieveworks.sources import sinks


def scored(predictions: DataFrame, items: DataFrame) -> DataFrame:
    """Predictions (item_id, prediction_raw, truth, ...) with ``extracted`` and ``correct``, by the labels and choices of the item's task.

    Labels are few and short by definition, so the items carry them; predictions
    without an item are gone, null predictions are wrong.
    """
    labels = reports.inferred_labels(items, ["item_id"]).select("task", "labels")
    keyed = items.select("item_id", "task", F.col("choice_0").isNotNull().alias("__choice")).join(labels, "task").drop("task")
    df = predictions.join(keyed, "item_id")
    df = df.withColumn("extracted", scoring.final_answer(F.col("prediction_raw"), F.col("truth"), F.col("__choice"), F.col("labels")))
    return df.withColumn("correct", scoring.is_correct(F.col("extracted"), F.col("truth"), F.col("__choice"))).drop("__choice", "labels")


def summary(scores: DataFrame, by: Sequence[str] = ("model_name",)) -> tuple[DataFrame, DataFrame]:
    """(per task, micro and macro) of scored predictions."""
    per_task = reports.task_accuracy(scores, [*by, "task"], "correct")
    return per_task, reports.micro_macro(per_task, by)


def write_report(scores: DataFrame, path: str, by: Sequence[str] = ("model_name",)) -> None:
    """Responses in one folder per task; per task a JSON and Markdown report with the models' micro and macro accuracies."""
    scores.write.partitionBy("task").json(f"{path}_responses")
    per_task, over_all = summary(scores, by)
    lines = {" ".join(str(r[b]) for b in by): f"micro {r['micro_pct']}, macro {r['macro_pct']}" for r in sinks.small_rows(over_all)} if by else {}
    sinks.write_report(lines, per_task.orderBy(*by, "task"), path)
