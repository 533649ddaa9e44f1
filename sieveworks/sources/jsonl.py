"""JSON and JSON-lines sources with strict parsing and a stated way with bad lines.

Spark's JSON readers accept trailing text, single quotes and other things that
strict parsers reject, so lines are judged in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sieveworks.functions.text import is_blank

OK, NOT_OBJECT, INVALID, BLANK = "ok", "not_object", "invalid", "blank"


@F.pandas_udf(T.StringType())
def line_status(lines: pd.Series) -> pd.Series:
    """ok, not_object, invalid or blank."""

    def of(t: str | None) -> str:
        if t is None or not t.strip():
            return BLANK
        try:
            return OK if isinstance(json.loads(t), dict) else NOT_OBJECT
        except ValueError:
            return INVALID

    return lines.map(of)


def field_of(fields: Sequence[str]):
    """UDF: per line a struct of each field's text and of whether it is there; null for null, JSON for lists and objects."""
    schema = ", ".join([f"`{f}` string, `{f}__there` boolean" for f in fields])

    @F.pandas_udf(schema)
    def parse(lines: pd.Series) -> pd.DataFrame:
        rows = []
        for t in lines:
            try:
                got = json.loads(t) if t else None
            except ValueError:
                got = None
            got = got if isinstance(got, dict) else {}
            row: list = []
            for f in fields:
                v = got.get(f)
                row += [v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False), f in got]
            rows.append(row)
        return pd.DataFrame(rows, columns=[x for f in fields for x in (f, f"{f}__there")])

    return parse


def lines(spark: SparkSession, path: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """(value, _source_file, _source_line): text lines with the number, from 1, in their file.

    Numbers come from the offsets of the lines, ranked within a file: a file is
    read in one piece only where it is one split, so each split's lines are
    counted first and numbered from there.
    """
    read = spark.read.text(list(path) if not isinstance(path, str) else path, recursiveFileLookup=recursive)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mono"))
    numbered = read.select("value", F.col("_metadata.file_path").alias("_source_file"), at.alias("__at"))
    counts = numbered.groupBy("_source_file", F.col("__at.block").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.min("__at.mono").alias("first"))
    before = Window.partitionBy("_source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_source_file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    joined = numbered.withColumn("block", F.col("__at.block")).join(starts, ["_source_file", "block"])
    return joined.select("value", "_source_file", (F.col("__at.mono") - F.col("first") + F.col("start") + 1).alias("_source_line"))


def read_records(spark: SparkSession, path: str | Sequence[str], fields: Sequence[str], mode: str = "drop", recursive: bool = False) -> DataFrame:
    """The named fields of each JSON line, with file and line number.

    ``mode``: ``drop`` leaves bad lines out, ``fail`` raises when one is met,
    ``keep`` gives them with ``status`` and null fields, ``count`` gives the
    number of lines per status instead. Blank lines are always left out.
    """
    df = lines(spark, path, recursive).filter(~is_blank(F.col("value"))).withColumn("status", line_status("value"))
    if mode == "count":
        return df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    parsed = df.withColumn("__f", field_of(fields)("value"))
    out = parsed.select("value", "_source_file", "_source_line", "status", *[F.col(f"__f.`{f}`").alias(f) for f in fields])
    if mode == "keep":
        return out
    if mode == "fail":
        bad = F.raise_error(F.concat(F.lit("bad JSON line "), F.col("_source_line").cast("string"), F.lit(" of "), F.col("_source_file")))
        return out.withColumn("status", F.when(F.col("status") == OK, F.col("status")).otherwise(bad.cast("string"))).filter(F.col("status") == OK).drop("value", "status")
    if mode != "drop":
        raise ValueError(mode)
    return out.filter(F.col("status") == OK).drop("value", "status")


def read_documents(spark: SparkSession, path: str, list_key: str | None = None) -> DataFrame:
    """(record, _source_file): the records of whole JSON files: a list's elements, those of ``list_key``, or the object itself; where a file is no JSON, its lines. Anything else raises."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_source_file"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, file in zip(b["value"], b["_source_file"]):
                yield pd.DataFrame({"record": [json.dumps(r, ensure_ascii=False) for r in extract_records(text, list_key)], "_source_file": file})

    return files.mapInPandas(run, "record string, _source_file string")


def extract_records(text: str, list_key: str | None = None) -> list:
    try:
        got = json.loads(text)
    except ValueError:
        rows = []
        for i, t in enumerate(text.splitlines(), 1):
            if t.strip():
                try:
                    rows.append(json.loads(t))
                except ValueError as e:
                    raise ValueError(f"line {i}: {e}") from None
        if not rows:
            raise ValueError("no JSON") from None
        return rows
    if isinstance(got, list):
        return got
    if isinstance(got, dict):
        if list_key is None:
            return [got]
        if not isinstance(got.get(list_key), list):
            raise ValueError(f"{list_key!r} is no list")
        return got[list_key]
    raise ValueError("neither list nor object")


def python_text(c: Column) -> Column:
    """Compatibility: the text of a null is 'None', as where records are read with ``str(get(key, ''))``."""
    return F.coalesce(c, F.lit("None"))
