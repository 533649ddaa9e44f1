"""Shared reading of instruction records for the llm operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.runtime import table

#: Ways in which a language is written, by its code (fixed values).
LANG_CODES = {"zh": ("zh", "cn", "chi", "zho", "chinese"), "en": ("en", "eng", "english"), "fr": ("fr", "fra", "fre", "french")}


def source_key(source: Column, source_file: Column) -> Column:
    """The origin of a record: its delivery file without shard and suffix, else the cleaned ``source``; ``'unknown'`` without both."""
    stem = F.regexp_extract(source_file, r"^(?:.*/)?([^/]+?)(?:_sft)?(?:_\d+)?\.jsonl?$", 1)
    return F.coalesce(F.nullif(F.lower(F.trim(stem)), F.lit("")), F.nullif(F.lower(F.trim(source)), F.lit("")), F.lit("unknown"))


def lang_key(lang: Column) -> Column:
    """One code for each language, however it is written; ``'unknown'`` for null or blank."""
    head = F.lower(F.split(F.trim(lang), r"[-_]")[0])
    out = F.when(head.isNull() | (head == ""), F.lit("unknown"))
    for code, ways in LANG_CODES.items():
        out = out.when(head.isin(*ways), F.lit(code))
    return out.otherwise(head)


def sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sft_records")
