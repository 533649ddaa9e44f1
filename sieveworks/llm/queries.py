"""Queries of the llm operators over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions.text import strip
from sieveworks.llm import completeness, leaks, neardup, packing, pairs, spam, tokens, variety
from sieveworks.llm.records import lang_key, sft, source_key
from sieveworks.runtime import cut_lineage, ship, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return completeness.truncated_values(sft(spark, d))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return completeness.truncation_rates(sft(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_fields(sft(spark, d))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defect_rates(sft(spark, d))


def p3_selected(spark: SparkSession, d: str) -> DataFrame:
    return variety.varied_subsets(sft(spark, d), table(spark, d, "sample_targets"))


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The value of each subset."""
    chosen = cut_lineage(p3_selected(spark, d))
    return variety.coverage(variety.featured(sft(spark, d), "record_id", "task_name", ("instruction", "input")), chosen)


TOKEN_FIELDS = ("input", "reasoning", "output")
TOKEN_DIMS = ("source", "lang", "domain")
TOKEN_MEASURES = (*(f"{f}_tokens" for f in TOKEN_FIELDS), "total_tokens")


def _dims() -> dict[str, Column]:
    domain = F.coalesce(F.nullif(F.trim("task_name"), F.lit("")), F.lit("unknown"))
    return {"source": source_key(F.col("source"), F.col("_source_file")), "lang": lang_key(F.col("lang")), "domain": domain}


def _counted(df: DataFrame, vocabulary: tokens.Vocabulary, ledger: tokens.Ledger) -> DataFrame:
    return tokens.record_tokens(df, TOKEN_FIELDS, "record_id", _dims(), vocabulary, ledger)


def p4_record_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Through a ledger that is empty at first, so that each run of the query encodes all contents."""
    return _counted(sft(spark, d), tokens.Vocabulary.read(), tokens.Ledger.new(spark))


def p4_token_cube(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_cube(p4_record_tokens(spark, d), TOKEN_DIMS, TOKEN_MEASURES)


def p4_maintained_cube(spark: SparkSession, d: str) -> DataFrame:
    """The cube kept up over three deliveries by one ledger and signed deltas.

    First the records ingested in the earlier half of the time; then all of
    them, with white space around their texts gone (changed records) and those
    without an output left out (removed records); then the table as it is.
    """
    df, vocabulary, ledger = sft(spark, d), tokens.Vocabulary.read(), tokens.Ledger.new(spark)
    at = F.unix_micros(F.col("ingested_at").cast("timestamp"))
    span = df.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    middle = (span["a"] + span["b"]) // 2 if span["a"] is not None else 0
    tidy = df.withColumns({f: strip(F.col(f)) for f in TOKEN_FIELDS}).filter("output <> ''")
    cube, before = None, None
    for delivery in (df.filter(at <= middle), tidy, df):
        state = cut_lineage(_counted(delivery, vocabulary, ledger))
        if cube is None:
            cube = tokens.token_cube(state, TOKEN_DIMS, TOKEN_MEASURES)
        else:
            cube = cut_lineage(tokens.apply_deltas(cube, tokens.cube_deltas(before, state, "record_id", TOKEN_DIMS, TOKEN_MEASURES), TOKEN_DIMS, TOKEN_MEASURES))
        before = state
    return cube


def _packed(spark: SparkSession, d: str) -> DataFrame:
    lengths = packing.document_lengths(table(spark, d, "documents"), tokens.Vocabulary.read())
    return packing.pack_documents(lengths, table(spark, d, "pack_capacities"))


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_fill(_packed(spark, d), table(spark, d, "pack_capacities"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, d, "documents"), leaks.held_out(spark, d))


def p7_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Each leaked item with the number of documents that hold it."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents")).select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_records(sft(spark, d), F.col("record_id"), F.col("input"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similarity_classes(sft(spark, d), F.col("record_id"), F.col("input"))


_QUERIES = (
    p1_found, p1_rates, p2_found, p2_rates, p3_selected, p3_coverage, p4_record_tokens, p4_token_cube, p4_maintained_cube, p5_found, p5_classes,
    p6_packed, p6_fill, p7_found, p7_leaked_items, p8_found, p8_scores,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, d: str) -> DataFrame:
            ship(spark)
            return f(spark, d)

        return run

    return {f.__name__: shipped(f) for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """None of these operators can be said in SQL; tests compare them with brute force."""
    return {}
