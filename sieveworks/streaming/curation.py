"""Curation of records as they arrive. The stateless operators work on streams as they are; these add what needs time or a sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sieveworks.operators.curate import enrich, is_valid


def curated(stream: DataFrame, drop_empty_output: bool = True) -> DataFrame:
    """Valid records of a stream, classified and enriched."""
    return enrich(stream.filter(is_valid(drop_empty_output=drop_empty_output)))


def delivered_once(stream: DataFrame, key: str, at: str, late: str = "3 days") -> DataFrame:
    """The first delivery of each key; the state holds the keys of the time that records may be late."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def arrivals(stream: DataFrame, at: str, by: str, window: str = "1 day", late: str = "3 days") -> DataFrame:
    """Records per window of time and group."""
    counts = stream.withWatermark(at, late).groupBy(F.window(at, window), by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("start"), by, "n")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """``each`` over all that has arrived, in batches; a batch that is repeated after a failure has the same number."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_folder(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
