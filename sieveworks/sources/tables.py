"""Text-table sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions.text import strip


def tsv(spark: SparkSession, path: str, names: tuple[str, ...] = ("instruction", "input", "output")) -> DataFrame:
    """Tab-separated text without a header; for question and answer files ``names`` are input and output."""
    return spark.read.csv(path, sep="\t", header=False, schema=", ".join(f"`{n}` string" for n in names), quote="")


def score_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="task string, model_name string, score double, abstention_rate double")


def item_counts(spark: SparkSession, path: str) -> DataFrame:
    """(task, n) of task files that hold a JSON array each."""
    read = spark.read.option("multiLine", True).json(path).select(F.col("_metadata.file_name").alias("file"))
    return read.groupBy(F.regexp_replace("file", r"\.json\z", "").alias("task")).agg(F.count(F.lit(1)).alias("n"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines; blank ones stay."""
    return spark.read.text(path).select(strip(F.col("value")).alias("text"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq) of lines of a word and, maybe, its frequency."""
    parts = F.split(strip(F.col("value")), r"\s+")
    return spark.read.text(path).filter(strip(F.col("value")) != "").select(parts[0].alias("word"), F.try_element_at(parts, F.lit(2)).try_cast("long").alias("freq"))


def task_folders(spark: SparkSession, path: str) -> DataFrame:
    """Items of a folder with one sub-folder of JSON lines for each task, with ``task`` from its name; columns that a task lacks are null."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(path)
    return read.withColumn("task", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+\z", 1))
