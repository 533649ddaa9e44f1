"""Aggregates and reports. Sums are kept as integers until the last division, so results don't depend on the order of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveworks.functions.text import rounded_share, sanitize


def short_stats(df: DataFrame, by: Column, text: Column, limits: Sequence[int] = (100, 200)) -> DataFrame:
    """Per group: rows, rows shorter than each limit, and their percentages (2 digits). Null texts are not counted."""
    n = F.count(F.lit(1))
    df = df.select(by.alias("grp"), F.length(text).alias("n")).filter("n is not null")
    counts = df.groupBy("grp").agg(n.alias("total"), *[F.count_if(F.col("n") < m).alias(f"below_{m}") for m in limits])
    return counts.select("*", *[rounded_share(F.col(f"below_{m}"), F.col("total"), 2).alias(f"pct_below_{m}") for m in limits])


def nearest_rank(df: DataFrame, value: Column, by: Sequence[str] = (), shares: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """n, min, mean, max and the value at index floor(n * share) of the sorted values.

    Equal values are counted first, so that only distinct values are ranked,
    and no group is gathered into one row.
    """
    values = df.select(*by, value.alias("v")).filter("v is not null").groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c"))
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = values.withColumn("upto", F.sum("c").over(over.orderBy("v"))).withColumn("n", F.sum("c").over(over))
    at = lambda q: F.floor(F.col("n").cast("double") * F.lit(float(q)))
    picks = [F.max(F.when((F.col("upto") > at(q)) & (F.col("upto") - F.col("c") <= at(q)), F.col("v"))).alias(f"p{int(q * 100)}") for q in shares]
    mean = (F.sum(F.col("v") * F.col("c")).cast("double") / F.sum("c").cast("double")).alias("mean")
    return ranked.groupBy(*by).agg(F.sum("c").alias("n"), F.min("v").alias("min"), mean, F.max("v").alias("max"), *picks).filter("n is not null")


def counted(df: DataFrame, by: str, order: Column) -> DataFrame:
    """Counts, commonest first; ties by first appearance in ``order``."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first")


# --- evaluation of predictions -----------------------------------------------------------------------


def task_accuracy(df: DataFrame, by: Sequence[str] = ("task",), matched: str = "matched") -> DataFrame:
    """Per group: n, correct (null counts as wrong), and accuracy in per cent (2 digits)."""
    per = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col(matched), F.lit(False))).alias("correct"))
    return per.withColumn("accuracy_pct", rounded_share(F.col("correct"), F.col("n"), 2))


def _ten_thousandths(c: Column) -> Column:
    return F.round(c * 10_000).cast("long")


def _mean_4(total: Column, n: Column) -> Column:
    """Mean to 4 digits of values whose ten-thousandths add up to the whole number ``total``: a tie is one in every order of the rows."""
    return F.round(total.cast("double") / n.cast("double")) / 10_000.0


def micro_macro(per_task: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Micro accuracy over all rows, and macro accuracy as the mean of the rounded percentages of the tasks."""
    hundredths = F.sum(F.round(F.col("accuracy_pct") * 100).cast("long"))
    agg = per_task.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tasks"), F.sum("n").alias("n"), F.sum("correct").alias("correct"), hundredths.alias("h"))
    macro = _mean_4(F.col("h") * 100, F.col("n_tasks")).alias("macro_pct")
    return agg.select(*by, "n_tasks", "n", "correct", rounded_share(F.col("correct"), F.col("n"), 4).alias("micro_pct"), macro)


def inferred_labels(df: DataFrame, order: Sequence[str], most: int = 12, longest: int = 80) -> DataFrame:
    """Per task: its distinct answers (first spelling, by first appearance) if they are few and short enough to be labels, else none."""
    from sieveworks.functions.scoring import normalize_label

    first = F.min(F.struct(*order, F.lit(0).alias("z"), sanitize(F.col("answer")).alias("label")))
    per = df.groupBy("task", normalize_label(F.coalesce(F.col("answer"), F.lit("None"))).alias("key")).agg(first.alias("first"))
    # no task with more distinct answers than `most` is gathered
    few = per.groupBy("task").agg(F.count(F.lit(1)).alias("k"), F.max(F.length("first.label")).alias("long"))
    ok = few.filter((F.col("k") <= most) & (F.col("long") <= longest)).select("task")
    gathered = per.join(ok, "task").groupBy("task").agg(F.transform(F.sort_array(F.collect_list("first")), lambda x: x["label"]).alias("labels"))
    return few.select("task", F.col("k").alias("n_answers")).join(gathered, "task", "left").select("task", "n_answers", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def split_scores(scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """(split, task, score, abstention_rate) with (split, task, n), null n unknown: per split the macro means, and the means weighted by n where it is known."""
    df = scores.join(sizes, ["split", "task"], "left")
    known = F.when(F.col("n").isNotNull(), F.col("n"))

    def pct(c: Column) -> Column:
        return F.round(c * 100, 4)

    agg = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.sum(known).alias("total"),
        F.avg("score").alias("ms"), F.avg("abstention_rate").alias("ma"), F.sum(F.col("score") * known).alias("ws"), F.sum(F.col("abstention_rate") * known).alias("wa"),
    )
    usable = F.col("total") > 0
    return agg.select(
        "split", "n_tasks", F.when(usable, F.col("total")).alias("total_samples"),
        pct(F.col("ms")).alias("macro_score_pct"), pct(F.when(usable, F.col("ws") / F.col("total")).otherwise(F.col("ms"))).alias("weighted_score_pct"),
        pct(F.col("ma")).alias("macro_abstention_pct"), pct(F.when(usable, F.col("wa") / F.col("total")).otherwise(F.col("ma"))).alias("weighted_abstention_pct"),
    )


def group_scores(scores: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per split and group (the task's name before its first '-'): tasks, samples (null for none), and the mean of the tasks' rounded percentages."""
    df = scores.join(sizes, ["split", "task"], "left").withColumn("grp", F.substring_index("task", "-", 1))
    mean = lambda c: _mean_4(F.sum(_ten_thousandths(F.col(c) * 100)), F.count(F.lit(1)))
    agg = df.groupBy("split", "grp").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.sum(F.coalesce("n", F.lit(0))).alias("total"), mean("score").alias("macro_score_pct"), mean("abstention_rate").alias("macro_abstention_pct")
    )
    return agg.select("split", "grp", "n_tasks", F.when(F.col("total") > 0, F.col("total")).alias("total_samples"), "macro_score_pct", "macro_abstention_pct")


def overall_scores(per_split: DataFrame) -> DataFrame:
    """All splits: macro as the mean of the splits' rounded macros, weighted by samples over the splits that have any (else the macro)."""
    s = F.coalesce("total_samples", F.lit(0)).cast("long")
    kinds = ("score", "abstention")
    sums = [F.sum(_ten_thousandths(F.col(f"macro_{k}_pct"))).alias(f"m_{k}") for k in kinds] + [F.sum(_ten_thousandths(F.col(f"weighted_{k}_pct")) * s).alias(f"w_{k}") for k in kinds]
    agg = per_split.agg(F.count(F.lit(1)).alias("n_splits"), F.sum("n_tasks").alias("n_tasks"), F.sum(s).alias("total"), *sums)
    out = [F.col("n_splits"), F.col("n_tasks"), F.when(F.col("total") > 0, F.col("total")).alias("total_samples")]
    for k in kinds:
        macro = _mean_4(F.col(f"m_{k}"), F.col("n_splits"))
        out += [macro.alias(f"macro_{k}_pct"), F.when(F.col("total") > 0, _mean_4(F.col(f"w_{k}"), F.col("total"))).otherwise(macro).alias(f"weighted_{k}_pct")]
    return agg.filter("n_splits > 0").select(*out)


# --- losses ------------------------------------------------------------------------------------------


def regression_errors(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Mean squared and mean absolute error over rows where both are known."""
    d = F.col(predicted) - F.col(truth)
    return df.agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"))


def pairwise_log_loss(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """Mean of -log sigmoid(chosen - rejected), in the form that doesn't overflow."""
    d = F.col(chosen) - F.col(rejected)
    return df.agg(F.avg(F.log1p(F.exp(-F.abs(d))) + F.greatest(-d, F.lit(0.0))).alias("log_loss"))


def perplexity_of(loss: Column) -> Column:
    """exp of the mean loss; infinite where that overflows."""
    return F.exp(F.avg(loss))


def padded_perplexity_of(loss: Column, text: Column, padded: int = 512) -> Column:
    """exp(sum of loss * padded length / (n * characters)): the older, non-standard form, padding included."""
    return F.exp(F.sum(loss * padded) / (F.count(F.lit(1)) * F.sum(F.length(text))))


def run_counters(df: DataFrame, kinds: Mapping[str, Column], file: str) -> DataFrame:
    """One row: rows scanned, rows of each kind (null is none), and files; one pass."""
    return df.agg(F.count(F.lit(1)).alias("scanned"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in kinds.items()], F.countDistinct(file).alias("files"))
