"""From raw records to training files."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.operators import curate, dedup, diverse, splits
from sieveworks.sources import files


def prepared(
    records: DataFrame, key: Sequence[str] = ("record_id",), ratio: float = 0.05, seed: int = 42, weights: Mapping[str, float] = curate.TASK_WEIGHTS, most: float = 3.0,
    mode: str = "replace", drop_empty_output: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, validation, train before rebalancing) of valid, enriched records, split within tasks; the task is told before the instruction is replaced."""
    ready = curate.enrich(records.filter(curate.is_valid(drop_empty_output=drop_empty_output)), mode)
    parts = splits.split_by_group(ready, "task_name", key, ratio, seed)
    train, validation = (parts.filter(F.col("split") == s).drop("split") for s in ("train", "validation"))
    weight = curate.lookup(weights, F.col("task_name"), weights.get("other", 1.0))
    return splits.rebalance(train, "task_name", key, weight, most, seed), validation, train


def prepared_counts(train: DataFrame, validation: DataFrame, before: DataFrame) -> DataFrame:
    """Per task: rows for training before and after rebalancing, and for validation."""
    stages = {"n_before": before, "n_train": train, "n_validation": validation}
    tagged = [df.select("task_name", *[F.lit(int(s == name)).alias(s) for s in stages]) for name, df in stages.items()]
    all_rows = tagged[0].unionAll(tagged[1]).unionAll(tagged[2])
    return all_rows.groupBy("task_name").agg(*[F.sum(s).alias(s) for s in stages])


def write_prepared(path: str, train: DataFrame, validation: DataFrame, before: DataFrame) -> None:
    """Folders ``train`` and ``validation`` of JSON lines, and ``metadata.json`` with the counts per task."""
    for name, df in (("train", train), ("validation", validation)):
        df.write.json(f"{path}/{name}")
    rows = prepared_counts(train, validation, before).orderBy("task_name").collect()  # one row per task
    counts = {r["task_name"]: {k: r[k] for k in ("n_before", "n_train", "n_validation")} for r in rows}
    files.write_text(f"{path}/metadata.json", json.dumps(counts, ensure_ascii=False, indent=2))


def thinned(records: DataFrame, key: str, size: int, text: str = "input", least: int = 100, shape: dedup.MinHash = dedup.MinHash(), seed: int = 42) -> DataFrame:
    """Long enough records without near-duplicates, with ``_sampled``: 'selected' for ``size`` diverse ones, 'remaining' for the others."""
    long_enough = curate.min_length(records, text, least)
    kept = long_enough.join(dedup.first_wins(long_enough.select(key, text), key, text, shape), key, "left_semi")
    return kept.join(diverse.diverse_sample(kept.select(key, text), key, text, size, seed=seed), key)
