"""All core queries over the test tables, each with its SQL where SQL can say it.

A query is the operator with production parameters over its whole table.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.functions import scoring, text
from sieveworks.operators import curate, dedup, dialog, diverse, generate, reports, splits, tokenized
from sieveworks.plans import curation, evaluation
from sieveworks.runtime import ship, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            ship(spark)
            return f(spark, d)

        _QUERIES[f.__name__] = run
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- SQL twins of the string functions ---------------------------------------------------------------


def q_strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\A{text.WS}+', ''), '{text.WS}+\z', '')"


def q_clean(x: str) -> str:
    return f"coalesce({q_strip(x)}, '')"


def q_blank(x: str) -> str:
    return f"({q_clean(x)} = '')"


def q_some(x: str) -> str:
    return f"nullif({q_strip(x)}, '')"


def q_think(x: str) -> str:
    return q_clean(rf"regexp_extract({x}, '(?is)<think>(.*?)</think>', 1)")


def q_has(x: str, tag: str) -> str:
    return rf"coalesce(regexp_matches({x}, '(?is)<{tag}>.*?</{tag}>'), false)"


def q_answer(x: str) -> str:
    t = f"coalesce({x}, '')"
    rest = q_strip(rf"regexp_replace({t}, '(?is)<think>.*?</think>', '', 'g')")
    inner = q_strip(rf"regexp_extract({t}, '(?is)<answer>(.*?)</answer>', 1)")
    return f"CASE WHEN {q_has(t, 'answer')} THEN {inner} WHEN {rest} <> '' THEN {rest} ELSE {q_strip(t)} END"


def q_visible(x: str) -> str:
    return rf"length(regexp_replace(coalesce({x}, ''), '{text.WS}+', '', 'g'))"


def q_label(x: str) -> str:
    collapsed = rf"regexp_replace({x}, '{text.WS}+', ' ', 'g')"
    return f"lower({q_strip(collapsed)})"


def q_text(x: str) -> str:
    inner = q_strip(rf"regexp_replace(regexp_replace(coalesce({x}, ''), '(?is)<think>.*?</think>', '', 'g'), '(?i)</?think>', '', 'g')")
    return q_label(inner)


def q_share(part: str, whole: str, digits: int) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0::DOUBLE ELSE round(({part})::DOUBLE * 100 / ({whole})::DOUBLE, {digits}) END"


def _sft(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sft_records")


#: A delivered row is one record here as it is in the files; the key of a row is its file and line.
ROW = ("_source_file", "_source_line")

# --- curation ------------------------------------------------------------------------------------------


@query(
    f"""SELECT grp, total, below_100, below_200, {q_share('below_100', 'total', 2)} AS pct_below_100, {q_share('below_200', 'total', 2)} AS pct_below_200
    FROM (SELECT _source_file AS grp, count(*) AS total, count(*) FILTER (length(input) < 100) AS below_100, count(*) FILTER (length(input) < 200) AS below_200
          FROM sft_records WHERE input IS NOT NULL GROUP BY 1)"""
)
def short_input_stats(spark: SparkSession, d: str) -> DataFrame:
    return reports.short_stats(_sft(spark, d), F.col("_source_file"), F.col("input"))


@query("SELECT record_id, _source_file, _source_line, length(input) AS n_chars FROM sft_records WHERE length(coalesce(input, '')) >= 100")
def filter_min_length(spark: SparkSession, d: str) -> DataFrame:
    return curate.min_length(_sft(spark, d)).select("record_id", *ROW, F.length("input").cast("long").alias("n_chars"))


@query(f"SELECT record_id, _source_file, _source_line FROM sft_records WHERE {q_clean('output')} = {q_clean('output_model')}")
def filter_consistent_outputs(spark: SparkSession, d: str) -> DataFrame:
    return curate.consistent(_sft(spark, d)).select("record_id", *ROW)


@query(
    f"""SELECT record_id, _source_file, _source_line FROM sft_records WHERE {q_clean('output')} <> {q_clean('output_model')}
    ORDER BY _source_file, _source_line LIMIT 5"""
)
def first_inconsistent(spark: SparkSession, d: str) -> DataFrame:
    return curate.first_mismatches(_sft(spark, d), ROW).select("record_id", *ROW)


@query(
    f"""SELECT coalesce(CASE WHEN reasoning = '' THEN 'empty_reasoning' WHEN lower({q_clean('output')}) = 'unknown' THEN 'unknown_output' END, 'kept') AS reason, count(*) AS n
    FROM sft_records GROUP BY 1"""
)
def filter_unknown_or_empty(spark: SparkSession, d: str) -> DataFrame:
    return _sft(spark, d).groupBy(F.coalesce(curate.drop_reason(), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT _source_file, count(*) AS n, count(*) FILTER (NOT {q_blank('instruction')} AND NOT {q_blank('input')}) AS n_valid,
    count(*) FILTER (NOT {q_blank('instruction')} AND NOT {q_blank('input')} AND NOT {q_blank('output')}) AS n_complete FROM sft_records GROUP BY 1"""
)
def validate_records(spark: SparkSession, d: str) -> DataFrame:
    good, full = curate.is_valid(), curate.is_valid(drop_empty_output=True)
    return _sft(spark, d).groupBy("_source_file").agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("n_valid"), F.count_if(full).alias("n_complete"))


@query(f"SELECT record_id, _source_file, _source_line FROM sft_records WHERE {q_blank('reasoning')} OR {q_blank('output_model')}")
def needs_generation(spark: SparkSession, d: str) -> DataFrame:
    return _sft(spark, d).filter(curate.needs_generation()).select("record_id", *ROW)


_Q_PRECHECK = f"""CASE WHEN concat_ws(',', CASE WHEN instruction IS NULL THEN 'instruction' END, CASE WHEN input IS NULL THEN 'input' END, CASE WHEN output IS NULL THEN 'output' END) <> ''
    THEN 'missing_fields:' || concat_ws(',', CASE WHEN instruction IS NULL THEN 'instruction' END, CASE WHEN input IS NULL THEN 'input' END, CASE WHEN output IS NULL THEN 'output' END)
    WHEN {q_blank('instruction')} OR {q_blank('input')} OR {q_blank('output')} THEN 'empty_required_field' ELSE 'ok' END"""


@query(f"SELECT reason, count(*) AS n, min(record_id) AS first FROM (SELECT record_id, {_Q_PRECHECK} AS reason FROM sft_records) GROUP BY 1")
def precheck_reasons(spark: SparkSession, d: str) -> DataFrame:
    return reports.counted(_sft(spark, d).withColumn("reason", curate.precheck_reason()), "reason", F.col("record_id"))


@query(
    f"""SELECT reason, record_id, _source_file, _source_line, example_rank FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY _source_file, _source_line) AS example_rank
    FROM (SELECT record_id, _source_file, _source_line, {_Q_PRECHECK} AS reason FROM sft_records)) WHERE example_rank <= 3"""
)
def precheck_examples(spark: SparkSession, d: str) -> DataFrame:
    df = _sft(spark, d).select("record_id", *ROW, curate.precheck_reason().alias("reason"))
    return curate.first_examples(df, "reason", ROW).withColumn("example_rank", F.col("example_rank").cast("long"))


@query(
    """SELECT lang, count(*) AS n, min(n_chars) AS min, sum(n_chars)::DOUBLE / count(*)::DOUBLE AS mean, max(n_chars) AS max,
    max(n_chars) FILTER (i = floor(k * 0.5::DOUBLE)) AS p50, max(n_chars) FILTER (i = floor(k * 0.9::DOUBLE)) AS p90, max(n_chars) FILTER (i = floor(k * 0.99::DOUBLE)) AS p99
    FROM (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, (count(*) OVER (PARTITION BY lang))::DOUBLE AS k FROM documents WHERE n_chars IS NOT NULL) GROUP BY lang"""
)
def length_summary_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return reports.nearest_rank(table(spark, d, "documents"), F.col("n_chars"), ["lang"])


@query("SELECT * EXCLUDE (_source_file, _source_line, _sampled, created_at, ingested_at) FROM sft_records")
def drop_provenance(spark: SparkSession, d: str) -> DataFrame:
    return curate.drop_provenance(_sft(spark, d)).drop("created_at", "ingested_at")


@query(f"SELECT record_id, _source_file, _source_line, concat_ws(chr(10), {q_some('instruction')}, {q_some('input')}) AS built FROM sft_records")
def build_text(spark: SparkSession, d: str) -> DataFrame:
    return _sft(spark, d).select("record_id", *ROW, text.build_text(F.col("instruction"), F.col("input")).alias("built"))


def _q_task() -> str:
    low = {"source": "lower(coalesce(source, ''))", "instruction": "lower(coalesce(instruction, ''))", "file": r"lower(regexp_extract(coalesce(_source_file, ''), '([^/]*)\z', 1))"}
    cases = " ".join(f"WHEN {' OR '.join(f'contains({low[w]}, {chr(39)}{x}{chr(39)})' for w, x in hits)} THEN '{task}'" for hits, task in curate.TASK_RULES)
    return f"CASE {cases} WHEN contains(lower(coalesce(input, '')), 'question') AND NOT {q_blank('output')} THEN 'reading_qa' ELSE 'other' END"


@query(f"SELECT record_id, _source_file, _source_line, {_q_task()} AS detected FROM sft_records")
def detect_task_name(spark: SparkSession, d: str) -> DataFrame:
    return _sft(spark, d).select("record_id", *ROW, curate.task_of().alias("detected"))


def _q_map(mapping: dict, key: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


@query(
    f"""SELECT record_id, _source_file, _source_line, task_name, coalesce({q_some('source')}, regexp_extract(coalesce(_source_file, ''), '([^/]*)\\z', 1)) AS dataset_name,
    {_q_map(curate.TASK_SYSTEM, 'task_name')} AS system_prompt,
    '[任务类型] ' || {_q_map(curate.TASK_DISPLAY, 'task_name')} || CASE WHEN {q_blank('instruction')} THEN '' ELSE chr(10) || {q_clean('instruction')} END AS instruction
    FROM (SELECT * EXCLUDE (task_name), {_q_task()} AS task_name FROM sft_records)"""
)
def enrich_records(spark: SparkSession, d: str) -> DataFrame:
    return curate.enrich(_sft(spark, d)).select("record_id", *ROW, "task_name", "dataset_name", "system_prompt", "instruction")


@query(
    f"""SELECT record_id, _source_file, _source_line, coalesce(instruction, '') || CASE WHEN {q_blank('input')} THEN '' ELSE chr(10) || chr(10) || input END AS human, coalesce(output, '') AS gpt
    FROM sft_records"""
)
def alpaca_to_sharegpt(spark: SparkSession, d: str) -> DataFrame:
    c = curate.alpaca_conversation(F.col("instruction"), F.col("input"), F.col("output"))
    return _sft(spark, d).select("record_id", *ROW, c.alias("c")).select("record_id", *ROW, F.col("c")[0]["value"].alias("human"), F.col("c")[1]["value"].alias("gpt"))


@query("SELECT item_id, coalesce(question, '') AS human, coalesce(answer, '') AS gpt FROM lawbench_item")
def qa_to_sharegpt(spark: SparkSession, d: str) -> DataFrame:
    c = curate.qa_conversation(F.col("question"), F.col("answer"))
    return table(spark, d, "lawbench_item").select("item_id", c.alias("c")).select("item_id", F.col("c")[0]["value"].alias("human"), F.col("c")[1]["value"].alias("gpt"))


_Q_WRAP = f"""'<think>' || chr(10) || CASE WHEN starts_with({q_strip('reasoning')}, '<think>') AND ends_with({q_strip('reasoning')}, '</think>')
    THEN {q_strip(f"substr({q_strip('reasoning')}, 8, greatest(length({q_strip('reasoning')}) - 15, 0))")} ELSE {q_strip('reasoning')} END || chr(10) || '</think>'"""


@query(
    f"""SELECT record_id, _source_file, _source_line,
    CASE WHEN {q_blank('system_prompt')} THEN '' ELSE '<|im_start|>system' || chr(10) || {q_strip('system_prompt')} || '<|im_end|>' || chr(10) END
    || '<|im_start|>user' || chr(10) || concat_ws(chr(10), {q_some('instruction')}, {q_some('input')}) || '<|im_end|>' || chr(10)
    || '<|im_start|>assistant' || chr(10) || CASE WHEN {q_blank('reasoning')} THEN {q_clean('output')} ELSE {_Q_WRAP} || chr(10) || {q_clean('output')} END || '<|im_end|>' || chr(10) AS rendered
    FROM sft_records"""
)
def render_chatml(spark: SparkSession, d: str) -> DataFrame:
    df = curate.tidied(_sft(spark, d), "system_prompt", "instruction", "input", "reasoning", "output")
    return df.select("record_id", *ROW, curate.chatml(curate.sft_messages(F.col("system_prompt"), tidy=True)).alias("rendered"))


@query(
    f"""SELECT record_id, _source_file, _source_line, concat_ws(chr(10) || chr(10), {q_some('instruction')}, {q_some('input')}) AS prompt,
    coalesce({q_some('input')}, {q_some('instruction')}, '') AS prompt_only_input FROM sft_records"""
)
def grpo_prompts(spark: SparkSession, d: str) -> DataFrame:
    return _sft(spark, d).select("record_id", *ROW, curate.grpo_prompt().alias("prompt"), curate.grpo_prompt(True).alias("prompt_only_input"))


@query("SELECT task_name, count(*) AS n FROM sft_records GROUP BY 1")
def counts_by_task(spark: SparkSession, d: str) -> DataFrame:
    return _sft(spark, d).groupBy("task_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT _source_file, count(*) AS n, max(_source_line) AS last_line FROM sft_records GROUP BY 1")
def rows_per_file(spark: SparkSession, d: str) -> DataFrame:
    return _sft(spark, d).groupBy("_source_file").agg(F.count(F.lit(1)).alias("n"), F.max("_source_line").alias("last_line"))


@query("SELECT DISTINCT record_id FROM sft_records WHERE record_id NOT IN (SELECT record_id FROM completion WHERE record_id IS NOT NULL)")
def unfinished_records(spark: SparkSession, d: str) -> DataFrame:
    return generate.unfinished(_sft(spark, d).select("record_id").distinct(), table(spark, d, "completion"), "record_id")


_Q_SHORT = f"CASE WHEN length(reasoning) <= 200 THEN reasoning WHEN cut >= 140 THEN substr(head, 1, cut + 1) ELSE head END"


@query(
    f"""WITH h AS (SELECT record_id, _source_file, _source_line, reasoning, regexp_replace(substr(reasoning, 1, 200), '{text.WS}+\\z', '') AS head FROM sft_records),
    c AS (SELECT *, greatest({', '.join(f"CASE WHEN contains(head, '{e}') THEN length(head) - instr(reverse(head), '{e}') ELSE -1 END" for e in text.SENTENCE_ENDS)}) AS cut FROM h)
    SELECT record_id, _source_file, _source_line, {_Q_SHORT} AS shortened FROM c"""
)
def shorten_reasoning(spark: SparkSession, d: str) -> DataFrame:
    return _sft(spark, d).select("record_id", *ROW, text.shorten(F.col("reasoning"), 200).alias("shortened"))


# --- splits and samples ----------------------------------------------------------------------------------

_Q_FIRST = "(SELECT record_id, task_name, source FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY _source_file, _source_line) AS rn FROM sft_records) WHERE rn = 1)"
_Q_RANK = f"SELECT record_id, task_name, row_number() OVER (PARTITION BY task_name ORDER BY md5('42|' || record_id), record_id) AS r, count(*) OVER (PARTITION BY task_name) AS n FROM {_Q_FIRST}"
_Q_HELD = "CASE WHEN n <= 1 THEN 0 ELSE least(greatest(1, round_even(n * 0.05::DOUBLE, 0)::BIGINT), n - 1) END"
_Q_SPLIT = f"SELECT record_id, task_name, CASE WHEN r <= {_Q_HELD} THEN 'validation' ELSE 'train' END AS split FROM ({_Q_RANK})"


def _records(spark: SparkSession, d: str) -> DataFrame:
    return _sft(spark, d).select("record_id", "task_name").dropDuplicates(["record_id"])


@query(_Q_SPLIT)
def split_by_task_rows(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_by_group(_records(spark, d), "task_name", ["record_id"])


@query(f"SELECT task_name, split, count(*) AS n FROM ({_Q_SPLIT}) GROUP BY 1, 2")
def split_by_task_counts(spark: SparkSession, d: str) -> DataFrame:
    return split_by_task_rows(spark, d).groupBy("task_name", "split").agg(F.count(F.lit(1)).alias("n"))


_Q_WEIGHT = "CASE task_name " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in curate.TASK_WEIGHTS.items()) + " ELSE 0.8::DOUBLE END"
_Q_TARGETS = f"""SELECT task_name, n, least(greatest(round_even(m * {_Q_WEIGHT}, 0)::BIGINT, 1), greatest(1, ceil(n * 3.0::DOUBLE)::BIGINT)) AS target
    FROM (SELECT task_name, count(*) AS n, max(count(*)) OVER () AS m FROM {_Q_FIRST} GROUP BY 1)"""


def _weight() -> Column:
    return curate.lookup(curate.TASK_WEIGHTS, F.col("task_name"), 0.8)


@query(_Q_TARGETS)
def rebalance_targets(spark: SparkSession, d: str) -> DataFrame:
    return splits.rebalance_targets(_records(spark, d).groupBy("task_name").agg(F.count(F.lit(1)).alias("n")), "task_name", "n", _weight())


@query(
    f"""WITH t AS ({_Q_TARGETS}), k AS ({_Q_RANK}), kept AS (SELECT k.record_id, k.task_name, 0::BIGINT AS replica FROM k JOIN t USING (task_name) WHERE k.r <= t.target),
    j AS (SELECT task_name, n, unnest(range(1, target - n + 1)) AS j FROM t WHERE target > n),
    c AS (SELECT task_name, ('0x' || substr(md5('42|' || j), 1, 8))::BIGINT % n + 1 AS r, count(*) AS copies FROM j GROUP BY 1, 2)
    SELECT * FROM kept UNION ALL SELECT k.record_id, k.task_name, unnest(range(1, c.copies + 1))::BIGINT AS replica FROM k JOIN c USING (task_name, r)"""
)
def rebalance_rows(spark: SparkSession, d: str) -> DataFrame:
    return splits.rebalance(_records(spark, d), "task_name", ["record_id"], _weight()).select("record_id", "task_name", "replica")


@query(
    """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) <= ceil((count(*) OVER ())::DOUBLE * 0.05::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM documents"""
)
def split_global(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_global(table(spark, d, "documents").select("doc_id"), ["doc_id"])


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor((count(*) OVER ())::DOUBLE * 95 / 100) THEN 'train' ELSE 'validation' END AS split FROM documents")
def positional_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.positional_split(table(spark, d, "documents").select("doc_id"), "doc_id", 95)


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id DESC) <= 100 THEN 'validation' ELSE 'train' END AS split FROM documents")
def tail_holdout(spark: SparkSession, d: str) -> DataFrame:
    return splits.tail_holdout(table(spark, d, "documents").select("doc_id"), "doc_id", 100)


@query("SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 100")
def max_samples(spark: SparkSession, d: str) -> DataFrame:
    return splits.sample_exact(table(spark, d, "documents").select("doc_id"), ["doc_id"], 100)


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= greatest(1, floor(n * 0.1::DOUBLE))")
def ratio_sample(spark: SparkSession, d: str) -> DataFrame:
    return splits.sample_ratio(table(spark, d, "documents").select("doc_id"), ["doc_id"], 0.1)


@query("SELECT record_id FROM (SELECT DISTINCT record_id FROM sft_records) ORDER BY md5('42|' || record_id), record_id LIMIT 100000")
def reservoir_pool(spark: SparkSession, d: str) -> DataFrame:
    return diverse.reservoir(_records(spark, d).select("record_id"), ["record_id"], 100_000)


_Q_PREPARED = f"""WITH o AS (SELECT DISTINCT record_id, {_q_task()} AS task_name FROM sft_records WHERE NOT {q_blank('instruction')} AND NOT {q_blank('input')} AND NOT {q_blank('output')}),
    c AS (SELECT task_name, count(*) AS n FROM o GROUP BY 1), v AS (SELECT task_name, n, ({_Q_HELD})::BIGINT AS n_validation FROM c),
    b AS (SELECT task_name, n_validation, n - n_validation AS n_before, max(n - n_validation) OVER () AS m FROM v)
    SELECT task_name, n_before, n_validation, least(greatest(round_even(m * {_Q_WEIGHT}, 0)::BIGINT, 1), greatest(1, ceil(n_before * 3.0::DOUBLE)::BIGINT)) AS n_train FROM b"""


@query(_Q_PREPARED)
def prepared_counts(spark: SparkSession, d: str) -> DataFrame:
    """The whole way from records to training and validation rows; a record delivered twice is one."""
    return curation.prepared_counts(*curation.prepared(_sft(spark, d).dropDuplicates(["record_id"])))


# --- near-duplicates and diversity ------------------------------------------------------------------------

_SHAPE = dedup.MinHash()


_Q_INPUTS = f"(SELECT record_id, any_value(input) AS t FROM sft_records WHERE NOT {q_blank('input')} GROUP BY 1)"


def _inputs(spark: SparkSession, d: str) -> DataFrame:
    """One input a record."""
    return _sft(spark, d).select("record_id", "input").dropDuplicates(["record_id"])


def _q_bands() -> str:
    a, b = (x.tolist() for x in _SHAPE.permutations())
    rows = ", ".join(f"({i // _SHAPE.rows}, {i % _SHAPE.rows}, {x}, {y})" for i, (x, y) in enumerate(zip(a, b)))
    code = lambda k: f"unicode(substr(t, i::INT + {k}, 1))::BIGINT"
    two = f"({code(0)} % {dedup.PRIME} * {dedup.GRAM_BASE} + {code(1)}) % {dedup.PRIME}"
    gram = f"CASE WHEN length(t) = 1 THEN {code(0)} % {dedup.PRIME} WHEN length(t) = 2 THEN {two} ELSE ({two} * {dedup.GRAM_BASE} + {code(2)}) % {dedup.PRIME} END"
    return f"""WITH p(band, r, a, b) AS (VALUES {rows}),
    g AS (SELECT DISTINCT record_id, {gram} AS h FROM (SELECT record_id, t, unnest(range(1, greatest(length(t) - 1, 2))) AS i FROM {_Q_INPUTS})),
    m AS (SELECT record_id, band, r, min((p.a * g.h + p.b) % {dedup.PRIME}) AS v FROM g CROSS JOIN p GROUP BY 1, 2, 3),
    w AS (SELECT record_id, band, max(v) FILTER (r = 0) AS v0, max(v) FILTER (r = 1) AS v1, max(v) FILTER (r = 2) AS v2 FROM m GROUP BY 1, 2)
    SELECT record_id AS key, band::INT AS band, ((v0 * {dedup.GRAM_BASE} + v1) % {dedup.PRIME} * {dedup.GRAM_BASE} + v2) % {dedup.PRIME} AS bucket FROM w"""


@query(_q_bands())
def minhash_bands(spark: SparkSession, d: str) -> DataFrame:
    return dedup.banded(_inputs(spark, d), "record_id", "input", _SHAPE)


@query(f"SELECT record_id, count(DISTINCT substr(t, i::INT, 3)) AS n_grams FROM (SELECT record_id, t, unnest(range(1, greatest(length(t) - 1, 2))) AS i FROM {_Q_INPUTS}) GROUP BY 1")
def char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    df = _inputs(spark, d).filter(~text.is_blank(F.col("input")))
    return df.select("record_id", F.size(text.char_ngrams(F.col("input"), 3)).cast("long").alias("n_grams"))


@query(
    f"""WITH RECURSIVE bands AS MATERIALIZED ({_q_bands()}), lower AS MATERIALIZED (SELECT x.key, list(DISTINCT y.key) AS keys FROM bands x JOIN bands y ON x.band = y.band AND x.bucket = y.bucket AND y.key < x.key GROUP BY 1),
    ordered AS MATERIALIZED (SELECT k.key, coalesce(l.keys, []) AS keys, row_number() OVER (ORDER BY k.key) AS n FROM (SELECT DISTINCT key FROM bands) k LEFT JOIN lower l ON l.key = k.key),
    scan(n, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT s.n + 1, CASE WHEN list_has_any(s.kept, o.keys) THEN s.kept ELSE list_append(s.kept, o.key) END FROM scan s JOIN ordered o ON o.n = s.n + 1)
    SELECT unnest(kept) AS record_id FROM (SELECT kept FROM scan ORDER BY n DESC LIMIT 1)"""
)
def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Over the records' inputs in the order of their ids, with the older, low threshold's bands."""
    return dedup.first_wins(_inputs(spark, d), "record_id", "input", _SHAPE)


@query(
    """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
    c AS (SELECT label, k, avg(x) AS m FROM e GROUP BY 1, 2), s AS (SELECT e.label, vec_id, sqrt(sum((x - m) * (x - m))) AS dist FROM e JOIN c ON e.label = c.label AND e.k = c.k GROUP BY 1, 2)
    SELECT label, vec_id, round(dist, 6) AS dist FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY dist, vec_id) = 1"""
)
def nearest_to_centroid(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    near = df.join(diverse.centroids(df, "label", "embedding"), "label")
    sq = F.aggregate(F.zip_with("embedding", "center", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda acc, x: acc + x)
    return diverse.nearest_to_center(near, "label", "vec_id", F.sqrt(sq)).withColumn("dist", F.round("dist", 6))


@query()
def diverse_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """5,000 of a pool of 100,000 records, by instruction, input and output as in the reference."""
    whole = text.build_text(F.col("instruction"), F.col("input"), F.col("output"))
    first = _sft(spark, d).select("record_id", whole.alias("text")).groupBy("record_id").agg(F.min("text").alias("text"))
    return diverse.diverse_sample(first, "record_id", "text")


@query(
    f"""WITH t AS (SELECT least(count(*), 100000)::BIGINT AS n FROM (SELECT record_id FROM sft_records WHERE NOT ({q_blank('instruction')} AND {q_blank('input')} AND {q_blank('output')}) GROUP BY 1))
    SELECT 'selected' AS sampled, least(n, 5000) AS n FROM t UNION ALL SELECT 'remaining', n - 5000 FROM t WHERE n > 5000"""
)
def diverse_sizes(spark: SparkSession, d: str) -> DataFrame:
    """What a diverse sample promises whatever the clusters are: its exact size, and all others of the pool."""
    return diverse_kmeans(spark, d).groupBy(F.col("_sampled").alias("sampled")).agg(F.count(F.lit(1)).alias("n"))


# --- dialogs ------------------------------------------------------------------------------------------------


def _dialogs(spark: SparkSession, d: str) -> DataFrame:
    """Preference pairs as dialogs: a system turn if there is one, the history, the question and the chosen answer."""
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), c.alias("value"))
    past = F.flatten(F.transform(F.coalesce("history", F.array().cast("array<array<string>>")), lambda p: F.array(turn("human", p[0]), turn("gpt", p[1]))))
    lead = F.when(F.col("system").isNotNull(), F.array(turn("system", F.col("system")))).otherwise(F.array().cast("array<struct<from:string,value:string>>"))
    own = F.array(turn("human", F.col("question")), turn("gpt", F.col("response_chosen")))
    return table(spark, d, "preference").select("pair_id", F.concat(lead, past, own).alias("conversations"))


@query(
    """SELECT pair_id, (question IS NOT NULL AND response_chosen IS NOT NULL AND len(list_filter(flatten(coalesce(history, [])), lambda x: x IS NULL)) = 0) AS valid FROM preference"""
)
def validate_sharegpt(spark: SparkSession, d: str) -> DataFrame:
    return _dialogs(spark, d).select("pair_id", curate.sharegpt_valid(F.col("conversations")).alias("valid"))


@query(
    """SELECT pair_id, len(coalesce(history, [])) + 1 AS n_pairs, coalesce(question, '') AS last_question, coalesce(response_chosen, '') AS last_answer, coalesce(system, '') AS system_prompt FROM preference"""
)
def normalize_dialog(spark: SparkSession, d: str) -> DataFrame:
    df = dialog.normalized_dialogs(_dialogs(spark, d))
    last = F.element_at("history", -1)
    return df.select("pair_id", F.size("history").cast("long").alias("n_pairs"), last[0].alias("last_question"), last[1].alias("last_answer"), "system_prompt")


_Q_ODD = """CASE WHEN system IS NOT NULL THEN 'led by a system' WHEN len(coalesce(history, [])) = 0 THEN 'led by a model' WHEN response_rejected IS NULL THEN 'odd' WHEN response_rejected = response_chosen THEN 'unknown speaker' ELSE 'two humans' END"""


def _odd_dialogs(spark: SparkSession, d: str) -> DataFrame:
    """Preference pairs as dialogs of all shapes: led by a system or a model, of odd length, with an unknown speaker, with two human turns in a row."""
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), F.col(c).alias("value"))
    asked, answered = turn("human", "question"), turn("gpt", "response_chosen")
    shape = (
        F.when(F.col("system").isNotNull(), F.array(turn("system", "system"), asked, answered))
        .when(F.size(F.coalesce("history", F.array().cast("array<array<string>>"))) == 0, F.array(answered, asked, answered))
        .when(F.col("response_rejected").isNull(), F.array(asked, answered, asked))
        .when(F.col("response_rejected") == F.col("response_chosen"), F.array(asked, turn("tool", "response_rejected"), answered))
        .otherwise(F.array(asked, asked, answered))
    )
    return table(spark, d, "preference").select("pair_id", shape.alias("conversations"))


@query(f"""SELECT pair_id, 1::BIGINT AS n_pairs, coalesce(question, '') AS asked, coalesce(response_chosen, '') AS answered, coalesce(system, '') AS system_prompt FROM preference WHERE {_Q_ODD} IN ('led by a system', 'led by a model')""")
def normalize_odd_dialogs(spark: SparkSession, d: str) -> DataFrame:
    df = dialog.normalized_dialogs(_odd_dialogs(spark, d))
    last = F.element_at("history", -1)
    return df.select("pair_id", F.size("history").cast("long").alias("n_pairs"), last[0].alias("asked"), last[1].alias("answered"), "system_prompt")


@query(f"""SELECT pair_id, 0::BIGINT AS turn, coalesce(question, '') AS query, coalesce(response_chosen, '') AS reply FROM preference WHERE {_Q_ODD} IN ('led by a system', 'led by a model')""")
def ppo_odd_prompts(spark: SparkSession, d: str) -> DataFrame:
    return dialog.turns_as_rows(_odd_dialogs(spark, d)).select("pair_id", F.col("turn").cast("long").alias("turn"), "query", "reply")


@query(
    """SELECT pair_id, t - 1 AS turn, query, reply FROM (
      SELECT pair_id, unnest(range(1, len(h) + 1)) AS t, unnest(list_transform(h, lambda p: coalesce(p[1], ''))) AS query, unnest(list_transform(h, lambda p: coalesce(p[2], ''))) AS reply
      FROM (SELECT pair_id, list_concat(coalesce(history, []), [[question, response_chosen]]) AS h FROM preference))"""
)
def ppo_prompts(spark: SparkSession, d: str) -> DataFrame:
    return dialog.turns_as_rows(_dialogs(spark, d)).select("pair_id", F.col("turn").cast("long").alias("turn"), "query", "reply")


@query("SELECT part, ord, human, gpt FROM (SELECT item_id // 100 AS part, item_id * 2 + 1 AS ord, last_value(question IGNORE NULLS) OVER (PARTITION BY item_id // 100 ORDER BY item_id) AS human, answer AS gpt FROM lawbench_item) WHERE human IS NOT NULL")
def human_gpt_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Questions and answers of the benchmark as turns in files of a hundred items."""
    items = table(spark, d, "lawbench_item").withColumn("part", F.floor(F.col("item_id") / 100))
    say = lambda who, c, k: F.struct((F.col("item_id") * 2 + k).alias("ord"), F.lit(who).alias("from"), F.col(c).alias("value"))
    turns = items.select("part", F.inline(F.array(say("human", "question", 0), say("gpt", "answer", 1))))
    return dialog.human_gpt_pairs(turns, "ord")


_VICUNA = dialog.TEMPLATES["vicuna"]
_Q_PREFERENCE = """array_to_string(list_transform(list_concat(coalesce(history, []), [[question, '']]), lambda p, i:
    CASE WHEN i = 1 THEN CASE WHEN coalesce(system, '') = '' THEN '{default}' ELSE system END || '</s>' ELSE '</s>' END || 'USER: ' || coalesce(p[1], '') || ' ASSISTANT:' || coalesce(p[2], '')), '')""".replace(
    "{default}", _VICUNA.system.replace("'", "''")
)


@query(f"SELECT pair_id, {_Q_PREFERENCE} AS prompt FROM preference")
def render_template(spark: SparkSession, d: str) -> DataFrame:
    return _preferences(spark, d).select("pair_id", "prompt")


def q_prompt(default: str, before: str, after: str, sep: str) -> str:
    """A prompt written out: line ends as @."""
    head = f"CASE WHEN i > 1 THEN '{sep}' WHEN coalesce(system, '') <> '' THEN system || '{sep}' ELSE '{default + sep if default else ''}' END"
    turns = f"list_transform(list_concat(coalesce(history, []), [[question, '']]), lambda p, i: {head} || '{before}' || coalesce(p[1], '') || '{after}' || coalesce(p[2], ''))"
    return f"replace(array_to_string({turns}, ''), '@', chr(10))"


@query(
    f"""SELECT pair_id, {q_prompt('', '问：', '@@答：', '@@')} AS chatglm2, {q_prompt('', '[INST] ', ' [/INST]', '</s>')} AS mistral,
    {q_prompt('You are a helpful assistant.', '<|im_start|>user@', '<|im_end|>@<|im_start|>assistant@', '<|im_end|>@')} AS chatml,
    {q_prompt('<|im_start|>system@You are a helpful assistant.<|im_end|>@', '<|im_start|>user@', '<|im_end|>@<|im_start|>assistant@', '@')} AS qwen,
    {q_prompt('<|start_header_id|>system<|end_header_id|>@@You are a helpful, excellent and smart assistant.', '<|start_header_id|>user<|end_header_id|>@@', '<|eot_id|><|start_header_id|>assistant<|end_header_id|>@@', '<|eot_id|>')} AS llama3,
    {q_prompt('', '<｜User｜>', '<｜Assistant｜>', '</s>')} AS deepseek3, {q_prompt('', '### Instruction:@', '@@### Response:@', '@@').replace("'' END", "'Below is an instruction that describes a task. Write a response that appropriately completes the request.@@' END")} AS alpaca
    FROM preference"""
)
def render_more_templates(spark: SparkSession, d: str) -> DataFrame:
    """Prompts in further formats; line ends and the mark that the SQL uses for them are one."""
    df = _preferences(spark, d)
    return df.select("pair_id", *[F.replace(dialog.preference_prompt(dialog.TEMPLATES[n]), F.lit("@"), F.lit("\n")).alias(n) for n in ("chatglm2", "mistral", "chatml", "qwen", "llama3", "deepseek3", "alpaca")])


def _preferences(spark: SparkSession, d: str) -> DataFrame:
    clean = F.transform("history", lambda p: F.transform(p, lambda x: F.coalesce(x, F.lit(""))))
    return table(spark, d, "preference").withColumn("history", clean).withColumn("prompt", dialog.preference_prompt(_VICUNA))


@query(
    f"""SELECT pair_id FROM (SELECT pair_id, length(p || coalesce(response_chosen, '')) AS a, length(p || coalesce(response_rejected, '')) AS b FROM (SELECT *, {_Q_PREFERENCE} AS p FROM preference))
    WHERE a BETWEEN 1 AND 1200 AND b BETWEEN 1 AND 1200"""
)
def preference_filter(spark: SparkSession, d: str) -> DataFrame:
    return curate.preference_fits(_preferences(spark, d), 1000, 200).select("pair_id")


_Q_REPLY = """concat('Thought: ', coalesce(question, ''), CASE WHEN system IS NOT NULL THEN chr(10) || 'Action: look up' ELSE '' END, CASE WHEN response_chosen IS NOT NULL THEN chr(10) || 'Action Input: ' || response_chosen ELSE '' END,
    CASE WHEN response_rejected IS NOT NULL THEN chr(10) || 'Observation: ' || response_rejected ELSE '' END, chr(10) || 'Action: second' || chr(10) || 'Action Input: x' || chr(10) || 'Final Answer: ' || coalesce(question, ''))"""


@query(
    f"""WITH r AS (SELECT pair_id, {_Q_REPLY} AS t FROM preference), m AS (SELECT *, instr(t, chr(10) || 'Action:') AS i, instr(t, chr(10) || 'Action Input:') AS j, instr(t, chr(10) || 'Observation:') AS k FROM r),
    c AS (SELECT *, CASE WHEN i > 0 AND i < j AND k < j THEN {q_strip('t')} || chr(10) || 'Observation:' ELSE t END AS u FROM m),
    n AS (SELECT *, CASE WHEN i > 0 AND i < j THEN {q_strip('substr(t, i + 8, j - i - 8)')} ELSE '' END AS name, instr(u, chr(10) || 'Observation:') AS e FROM c)
    SELECT pair_id, name, CASE WHEN name <> '' THEN {q_strip('substr(u, j + 14, greatest(e - j - 14, 0))')} ELSE '' END AS arguments, CASE WHEN name <> '' THEN 'tool_calls' ELSE 'stop' END AS finish_reason,
    CASE WHEN name <> '' THEN {q_strip("substr(substr(t, 1, i - 1), 10)")} ELSE string_split(u, chr(10) || 'Final Answer: ')[-1] END AS content FROM n"""
)
def parsed_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies with one call, two, a call before its action, or an answer only: written from preference pairs."""
    line = lambda head, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n{head}: "), F.col(c))).otherwise("")
    asked = F.coalesce("question", F.lit(""))
    act = F.when(F.col("system").isNotNull(), F.lit("\nAction: look up")).otherwise("")
    reply = F.concat(F.lit("Thought: "), asked, act, line("Action Input", "response_chosen"), line("Observation", "response_rejected"), F.lit("\nAction: second\nAction Input: x\nFinal Answer: "), asked)
    return table(spark, d, "preference").select("pair_id", dialog.parsed_reply(reply).alias("r")).select("pair_id", "r.*")


def q_left(x: str) -> str:
    return rf"regexp_replace(regexp_replace(coalesce({x}, ''), '\A\n+', ''), '{text.WS}+\z', '')"


@query(
    f"""WITH m AS (SELECT pair_id, {q_left('system')} AS s, coalesce(history, []) AS h, {q_left('question')} AS q, response_chosen IS NOT NULL AS answered,
      {q_left("'Thought: ' || chr(10) || 'Action: search' || chr(10) || 'Action Input: ' || coalesce(response_chosen, '')")} AS called, {q_left('response_rejected')} AS seen, response_rejected IS NOT NULL AS observed FROM preference)
    SELECT pair_id, s AS system, CASE WHEN answered THEN len(h) + 1 ELSE len(h) END AS n_pairs, CASE WHEN NOT answered THEN q END AS query, CAST(NULL AS VARCHAR) AS error,
    CASE WHEN answered THEN called || CASE WHEN observed THEN chr(10) || 'Observation: ' || seen || chr(10) || 'Thought:' ELSE '' END WHEN len(h) > 0 THEN {q_left('h[-1][2]')} END AS last_answer FROM m"""
)
def chat_requests(spark: SparkSession, d: str) -> DataFrame:
    """Preference pairs as chat requests: the chosen answer as a call, the rejected one as what came back."""
    call = "struct<name:string,arguments:string>"
    say = lambda role, c, made=None: F.struct(F.lit(role).alias("role"), c.alias("content"), (F.lit(None).cast(call) if made is None else made).alias("tool_calls"))
    kind = f"array<struct<role:string,content:string,tool_calls:{call}>>"
    past = F.flatten(F.transform(F.coalesce("history", F.array().cast("array<array<string>>")), lambda p: F.array(say("user", p[0]), say("assistant", p[1]))))
    made = F.struct(F.lit("search").alias("name"), F.col("response_chosen").alias("arguments"))
    some = lambda c, x: F.when(F.col(c).isNotNull(), F.array(x).cast(kind)).otherwise(F.array().cast(kind))
    answer = some("response_chosen", say("assistant", F.lit(None).cast("string"), made))
    seen = F.when(F.col("response_chosen").isNotNull(), some("response_rejected", say("function", F.col("response_rejected")))).otherwise(F.array().cast(kind))
    messages = F.concat(some("system", say("system", F.col("system"))), past.cast(kind), F.array(say("user", F.col("question"))).cast(kind), answer, seen)
    df = dialog.chat_requests(table(spark, d, "preference").select("pair_id", messages.alias("messages")))
    last = F.try_element_at("request.history", F.lit(-1))
    return df.select("pair_id", "request.system", F.size("request.history").cast("long").alias("n_pairs"), "request.query", "request.error", last[1].alias("last_answer"))


# --- rewards and evaluation -----------------------------------------------------------------------------------


@query(
    f"""SELECT completion_id, {q_think("coalesce(content, '')")} AS think, {q_answer('content')} AS answer, {q_has('content', 'think')} AS has_think, {q_has('content', 'answer')} AS has_answer FROM completion"""
)
def extract_think_answer(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("content")
    return table(spark, d, "completion").select(
        "completion_id", text.think_text(F.coalesce(c, F.lit(""))).alias("think"), text.answer_text(c).alias("answer"), text.has_pair(c, "think").alias("has_think"), text.has_pair(c, "answer").alias("has_answer")
    )


_Q_PARTS = f"""SELECT completion_id, CASE WHEN {q_has('content', 'think')} AND {q_has('content', 'answer')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS format,
    least({q_visible(q_think("coalesce(content, '')"))}, 400)::DOUBLE / 400.0::DOUBLE AS think, {q_visible(q_answer('content'))} AS n FROM completion"""


@query(
    f"""SELECT completion_id, format, round(think, 6) AS think, round(p, 6) AS answer_penalty, round(format + think + p, 6) AS total FROM (
    SELECT *, CASE WHEN n <= 40 THEN 0.0::DOUBLE WHEN n >= 120 THEN -1.0::DOUBLE ELSE -((n - 40)::DOUBLE) / 80.0::DOUBLE END AS p FROM ({_Q_PARTS}))"""
)
def reward_scores(spark: SparkSession, d: str) -> DataFrame:
    r = scoring.reward_parts(F.col("content"), think_cap=400, soft=40, hard=120)
    df = table(spark, d, "completion").select("completion_id", r.alias("r"))
    return df.select("completion_id", "r.format", *[F.round(f"r.{c}", 6).alias(c) for c in ("think", "answer_penalty", "total")])


@query(
    rf"""SELECT completion_id, CASE WHEN regexp_matches(content, '\A<think>[^\n]*?</think><answer>[^\n]*?</answer>\n?\z') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS strict,
    CASE WHEN regexp_matches(content, '(?s)<answer>.*?</answer>') THEN {q_strip("regexp_extract(content, '(?s)<answer>(.*?)</answer>', 1)")} ELSE {q_clean('content')} END AS plain FROM completion"""
)
def old_rewards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "completion").select("completion_id", scoring.strict_format(F.col("content")).alias("strict"), scoring.plain_answer(F.col("content")).alias("plain"))


@query(
    f"""SELECT completion_id, CASE WHEN {q_blank('reference_output')} THEN 0.25::DOUBLE ELSE least(1.0::DOUBLE, length(reference_output)::DOUBLE / 100.0::DOUBLE) END AS judge FROM completion"""
)
def judge_cached(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in judge: the length of the reference, so that SQL can tell the same."""
    import json

    def judge(questions: list[str]) -> list[float]:
        return [len(json.loads(q)["reference_output"]) / 100.0 for q in questions]

    return generate.judged(table(spark, d, "completion"), ["prompt_text"], "reference_output", judge, 0.25).select("completion_id", "judge")


@query(
    f"""WITH a AS (SELECT task, item_id, coalesce(answer, 'None') AS answer, {q_label("coalesce(answer, 'None')")} AS key FROM legalbench_item),
    f AS (SELECT task, key, min(item_id) AS first, arg_min({q_clean('answer')}, item_id) AS label FROM a GROUP BY 1, 2),
    t AS (SELECT task, count(*) AS n_answers, max(length(label)) AS longest, string_agg(label, ' | ' ORDER BY first) AS labels FROM f GROUP BY 1)
    SELECT task, n_answers, CASE WHEN n_answers <= 12 AND longest <= 80 THEN labels ELSE '' END AS labels FROM t"""
)
def infer_labels(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "legalbench_item").withColumn("answer", F.coalesce("answer", F.lit("None")))
    return reports.inferred_labels(items, ["item_id"]).withColumn("labels", F.array_join("labels", " | "))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    """Whole-row repeats are one prediction."""
    return table(spark, d, "prediction").distinct()


_Q_PREDICTIONS = "(SELECT DISTINCT * FROM prediction)"


@query(
    f"""SELECT prediction_id, CASE WHEN got = '' THEN false WHEN got = want THEN true WHEN (want IN ('yes', 'no') AND got IN ('yes', 'no')) OR (choice AND want IN ('a', 'b', 'c', 'd', 'e')) THEN false
    ELSE contains(got, want) OR contains(want, got) END AS correct FROM (
    SELECT prediction_id, choice, CASE WHEN choice AND regexp_matches(g, '\\A[0-4]\\z') THEN translate(g, '01234', 'abcde') ELSE g END AS got,
      CASE WHEN choice AND regexp_matches(w, '\\A[0-4]\\z') THEN translate(w, '01234', 'abcde') ELSE w END AS want FROM (
        SELECT p.prediction_id, i.choice_0 IS NOT NULL AS choice, {q_text('p.prediction_extracted')} AS g, {q_text('p.truth')} AS w FROM {_Q_PREDICTIONS} p JOIN legalbench_item i USING (item_id)))"""
)
def match_answers(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "legalbench_item").select("item_id", F.col("choice_0").isNotNull().alias("choice"))
    df = _predictions(spark, d).join(items, "item_id")
    return df.select("prediction_id", scoring.is_correct(F.col("prediction_extracted"), F.col("truth"), F.col("choice")).alias("correct"))


_Q_SPLIT_LINES = r"[\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}\r\n]"
_Q_WORD = r"(?:^|[^\p{L}\p{N}_])"
_Q_WORD_END = r"(?:[^\p{L}\p{N}_]|$)"
_Q_UNTHOUGHT = q_strip(r"regexp_replace(regexp_replace(coalesce(prediction_raw, ''), '(?is)<think>.*?</think>', '', 'g'), '(?i)</?think>', '', 'g')")


def _q_in(text_: str) -> str:
    """The longest label of ``labels`` that stands in a normalised text between other than letters and digits."""
    quoted = r"regexp_replace(k.key, '([^a-z0-9 ])', '\\\1', 'g')"
    return f"""list_filter(labels, lambda k: k.key <> '' AND regexp_matches({text_}, '(?:^|[^a-z0-9])' || {quoted} || '(?:[^a-z0-9]|$)'))[1].label"""


_Q_SCORED = f"""a AS (SELECT task, {q_label("coalesce(answer, 'None')")} AS key, min(item_id) AS first, arg_min({q_clean('answer')}, item_id) AS label FROM legalbench_item GROUP BY 1, 2),
    g AS (SELECT task, CASE WHEN count(*) <= 12 AND max(length(label)) <= 80 THEN list({{'label': label, 'key': {q_label('label')}}} ORDER BY -length({q_label('label')}), first) ELSE [] END AS labels FROM a GROUP BY 1),
    b AS (SELECT p.*, i.choice_0 IS NOT NULL AS choice, g.labels, {q_text('p.prediction_raw')} AS txt, {q_text('p.truth')} AS want FROM {_Q_PREDICTIONS} p JOIN legalbench_item i USING (item_id) JOIN g ON g.task = i.task),
    c AS (SELECT *, list_filter(list_transform(regexp_split_to_array({_Q_UNTHOUGHT}, '{_Q_SPLIT_LINES}'), lambda x: {q_strip('x')}), lambda x: x <> '') AS lines FROM b),
    d AS (SELECT *, {q_text("coalesce(lines[-1], '')")} AS l0 FROM c),
    e AS (SELECT *, CASE WHEN starts_with(l0, 'final answer:') THEN {q_strip('substr(l0, 14)')} ELSE l0 END AS l1 FROM d),
    f AS (SELECT *, CASE WHEN starts_with(l1, 'answer:') THEN {q_strip('substr(l1, 8)')} ELSE l1 END AS line FROM e),
    x AS (SELECT *, coalesce(CASE WHEN want IN ('yes', 'no') THEN nullif(regexp_extract(txt, '{_Q_WORD}(yes|no){_Q_WORD_END}', 1), '') END,
      CASE WHEN choice THEN coalesce(nullif(regexp_extract(txt, '{_Q_WORD}([0-4]){_Q_WORD_END}', 1), ''), nullif(regexp_extract(txt, '{_Q_WORD}([a-e]){_Q_WORD_END}', 1), '')) END,
      {_q_in('txt')}, CASE WHEN len(lines) = 0 THEN txt ELSE coalesce({_q_in('line')}, line) END) AS extracted FROM f),
    y AS (SELECT *, CASE WHEN choice AND regexp_matches(e0, '\\A[0-4]\\z') THEN translate(e0, '01234', 'abcde') ELSE e0 END AS got, CASE WHEN choice AND regexp_matches(want, '\\A[0-4]\\z') THEN translate(want, '01234', 'abcde') ELSE want END AS due
      FROM (SELECT *, {q_text('extracted')} AS e0 FROM x)),
    scored AS (SELECT prediction_id, model_name, task, extracted, CASE WHEN got = '' THEN false WHEN got = due THEN true WHEN (due IN ('yes', 'no') AND got IN ('yes', 'no')) OR (choice AND due IN ('a', 'b', 'c', 'd', 'e')) THEN false
      ELSE contains(got, due) OR contains(due, got) END AS correct FROM y)"""


@query(f"WITH {_Q_SCORED} SELECT prediction_id, extracted, correct FROM scored")
def score_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Raw predictions: answer extracted by the task's labels and choices, and judged."""
    return evaluation.scored(_predictions(spark, d), table(spark, d, "legalbench_item")).select("prediction_id", "extracted", "correct")


@query(
    f"""WITH {_Q_SCORED}, t AS (SELECT model_name, task, count(*) AS n, count(*) FILTER (correct) AS correct FROM scored GROUP BY 1, 2), u AS (SELECT *, {q_share('correct', 'n', 2)} AS pct FROM t)
    SELECT model_name, count(*) AS n_tasks, sum(n)::BIGINT AS n, sum(correct)::BIGINT AS correct, {q_share('sum(correct)', 'sum(n)', 4)} AS micro_pct,
    round((sum(round(pct * 100)::BIGINT) * 100)::DOUBLE / count(*)::DOUBLE) / 10000.0::DOUBLE AS macro_pct FROM u GROUP BY 1"""
)
def evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    """Micro and macro accuracy of each model by the answers extracted here."""
    return evaluation.summary(evaluation.scored(_predictions(spark, d), table(spark, d, "legalbench_item")))[1]


_Q_ACCURACY = f"""SELECT model_name, task, n, correct, {q_share('correct', 'n', 2)} AS accuracy_pct FROM (
    SELECT model_name, task, count(*) AS n, count(*) FILTER (coalesce(matched, false)) AS correct FROM {_Q_PREDICTIONS} GROUP BY 1, 2)"""


@query(_Q_ACCURACY)
def task_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return reports.task_accuracy(_predictions(spark, d), ["model_name", "task"])


@query(
    f"""SELECT model_name, n_tasks, n, correct, {q_share('correct', 'n', 4)} AS micro_pct, round((h * 100)::DOUBLE / n_tasks::DOUBLE) / 10000.0::DOUBLE AS macro_pct FROM (
    SELECT model_name, count(*) AS n_tasks, sum(n)::BIGINT AS n, sum(correct)::BIGINT AS correct, sum(round(accuracy_pct * 100)::BIGINT)::BIGINT AS h FROM ({_Q_ACCURACY}) GROUP BY 1)"""
)
def micro_macro(spark: SparkSession, d: str) -> DataFrame:
    return reports.micro_macro(task_accuracy(spark, d), ["model_name"])


@query(f"SELECT prediction_id, contains(lower(regexp_replace(coalesce(prediction_raw, ''), '(?s)\\A.*</think>', '')), lower({q_clean('truth')})) AS contained FROM {_Q_PREDICTIONS}")
def containment_scores(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(spark, d).select("prediction_id", scoring.contains_truth(F.col("prediction_raw"), F.col("truth")).alias("contained"))


def _scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Scores by model (as split) and task; abstention is an empty extraction; sizes for tasks with enough items only."""
    p = _predictions(spark, d)
    n = F.count(F.lit(1)).cast("double")
    scores = p.groupBy(F.col("model_name").alias("split"), "task").agg(
        (F.count_if(F.coalesce("matched", F.lit(False))) / n).alias("score"), (F.count_if(F.coalesce("prediction_extracted", F.lit("")) == "") / n).alias("abstention_rate")
    )
    sizes = p.groupBy(F.col("model_name").alias("split"), "task").agg(F.countDistinct("item_id").alias("n")).filter("n >= 5")
    return scores, sizes


def _as_double(df: DataFrame) -> DataFrame:
    """Nullable counts as doubles, which compare alike in all clients."""
    return df.withColumn("total_samples", F.col("total_samples").cast("double"))


_Q_SCORES = f"""s AS (SELECT model_name AS split, task, count(*) FILTER (coalesce(matched, false))::DOUBLE / count(*)::DOUBLE AS score,
      count(*) FILTER (coalesce(prediction_extracted, '') = '')::DOUBLE / count(*)::DOUBLE AS abstention_rate FROM {_Q_PREDICTIONS} GROUP BY 1, 2),
    z AS (SELECT model_name AS split, task, count(DISTINCT item_id) AS n FROM {_Q_PREDICTIONS} GROUP BY 1, 2 HAVING count(DISTINCT item_id) >= 5),
    j AS (SELECT s.*, z.n FROM s LEFT JOIN z USING (split, task)),
    v AS (SELECT split, count(*) AS n_tasks, CASE WHEN sum(n) > 0 THEN sum(n)::DOUBLE END AS total_samples, round(avg(score) * 100, 4) AS macro_score_pct,
      round(CASE WHEN sum(n) > 0 THEN sum(score * n) / sum(n)::DOUBLE ELSE avg(score) END * 100, 4) AS weighted_score_pct, round(avg(abstention_rate) * 100, 4) AS macro_abstention_pct,
      round(CASE WHEN sum(n) > 0 THEN sum(abstention_rate * n) / sum(n)::DOUBLE ELSE avg(abstention_rate) END * 100, 4) AS weighted_abstention_pct FROM j GROUP BY 1)"""


@query(f"WITH {_Q_SCORES} SELECT * FROM v")
def lawbench_splits(spark: SparkSession, d: str) -> DataFrame:
    return _as_double(reports.split_scores(*_scores(spark, d)))


@query(
    f"""WITH {_Q_SCORES} SELECT split, regexp_extract(task, '\\A([^-]*)', 1) AS grp, count(*) AS n_tasks, CASE WHEN sum(coalesce(n, 0)) > 0 THEN sum(coalesce(n, 0))::DOUBLE END AS total_samples,
    round(sum(round(score * 100 * 10000))::DOUBLE / count(*)::DOUBLE) / 10000.0::DOUBLE AS macro_score_pct, round(sum(round(abstention_rate * 100 * 10000))::DOUBLE / count(*)::DOUBLE) / 10000.0::DOUBLE AS macro_abstention_pct FROM j GROUP BY 1, 2"""
)
def lawbench_groups(spark: SparkSession, d: str) -> DataFrame:
    return _as_double(reports.group_scores(*_scores(spark, d)))


@query(
    f"""WITH {_Q_SCORES}, i AS (SELECT n_tasks, coalesce(total_samples, 0)::BIGINT AS n, round(macro_score_pct * 10000)::BIGINT AS ms, round(weighted_score_pct * 10000)::BIGINT AS ws,
      round(macro_abstention_pct * 10000)::BIGINT AS ma, round(weighted_abstention_pct * 10000)::BIGINT AS wa FROM v)
    SELECT count(*) AS n_splits, sum(n_tasks)::BIGINT AS n_tasks, CASE WHEN sum(n) > 0 THEN sum(n)::DOUBLE END AS total_samples, round(sum(ms)::DOUBLE / count(*)::DOUBLE) / 10000.0::DOUBLE AS macro_score_pct,
    round(CASE WHEN sum(n) > 0 THEN sum(ws * n)::DOUBLE / sum(n)::DOUBLE ELSE sum(ms)::DOUBLE / count(*)::DOUBLE END) / 10000.0::DOUBLE AS weighted_score_pct,
    round(sum(ma)::DOUBLE / count(*)::DOUBLE) / 10000.0::DOUBLE AS macro_abstention_pct,
    round(CASE WHEN sum(n) > 0 THEN sum(wa * n)::DOUBLE / sum(n)::DOUBLE ELSE sum(ma)::DOUBLE / count(*)::DOUBLE END) / 10000.0::DOUBLE AS weighted_abstention_pct FROM i"""
)
def lawbench_overall(spark: SparkSession, d: str) -> DataFrame:
    return _as_double(reports.overall_scores(reports.split_scores(*_scores(spark, d))))


_PROMPT_COLUMNS = ("question", "contract", "text", "policy", "claim", "citation", "issue", *(f"choice_{i}" for i in range(5)))
#: Names of prompts that the table has no columns for.
_ABSENT = dict.fromkeys(("Citation", "Paragraph", "year", "slice", "description", "statute"))

_Q_ASK = f"""l AS (SELECT task, count(*) AS n, max(length(label)) AS longest, list(key) AS keys, string_agg(label, ', ' ORDER BY first) AS labels FROM (
      SELECT task, {q_label("coalesce(answer, 'None')")} AS key, min(item_id) AS first, arg_min({q_clean('answer')}, item_id) AS label FROM answers GROUP BY 1, 2) GROUP BY 1),
    asks AS (SELECT task, CASE WHEN n > 12 OR longest > 80 THEN 'Reply with only the final answer.' WHEN len(list_filter(keys, lambda x: x NOT IN ('yes', 'no'))) = 0 THEN 'Reply with only Yes or No.'
      WHEN len(list_filter(keys, lambda x: x NOT IN ('a', 'b', 'c', 'd', 'e'))) = 0 THEN 'Reply with only the best answer letter.' ELSE 'Reply with only one of: ' || labels || '.' END AS ask FROM l)"""


def _asked(answers: DataFrame) -> DataFrame:
    """(task, ask) from (task, item_id, answer)."""
    return reports.inferred_labels(answers, ["item_id"]).select("task", scoring.label_instruction(F.col("labels")).alias("ask"))


def _present(items: DataFrame) -> DataFrame:
    return items.groupBy("task").agg(F.array_compact(F.array(*[F.when(F.bool_or(F.col(c).isNotNull()), F.lit(c)) for c in _PROMPT_COLUMNS])).alias("present"))


@query(
    f"""WITH answers AS (SELECT task, item_id, answer FROM legalbench_item UNION ALL SELECT 'letters', item_id, translate(answer, '01234', 'abcde') FROM legalbench_item WHERE choice_0 IS NOT NULL
      UNION ALL SELECT task, item_id, answer FROM lawbench_item), {_Q_ASK} SELECT task, ask FROM asks"""
)
def label_instructions(spark: SparkSession, d: str) -> DataFrame:
    """How each task asks for its answer; also with the choices as letters, and for the tasks of long answers."""
    items = table(spark, d, "legalbench_item")
    letters = items.filter("choice_0 is not null").select(F.lit("letters").alias("task"), "item_id", F.translate("answer", "01234", "abcde").alias("answer"))
    pick = lambda df: df.select("task", "item_id", "answer")
    return _asked(pick(items).unionByName(letters).unionByName(pick(table(spark, d, "lawbench_item"))))


_Q_CHOICES = "concat_ws(chr(10), '(a) ' || choice_0, '(b) ' || choice_1, '(c) ' || choice_2, '(d) ' || choice_3, '(e) ' || choice_4)"


@query(
    f"""WITH answers AS (SELECT task, item_id, answer FROM legalbench_item), {_Q_ASK},
    h AS (SELECT task, bool_or(choice_0 IS NOT NULL) AS choice, bool_or(question IS NOT NULL) AS q, bool_or(contract IS NOT NULL) AS k, bool_or(text IS NOT NULL) AS t, bool_or(policy IS NOT NULL) AS p, bool_or(claim IS NOT NULL) AS c,
      bool_or(citation IS NOT NULL) AS ci, bool_or(issue IS NOT NULL) AS i FROM legalbench_item GROUP BY 1)
    SELECT item_id, replace(CASE
      WHEN choice THEN coalesce(question, '') || '@@' || {_Q_CHOICES} || '@@Reply with only the best answer choice using either the letter a-e or the index 0-4.'
      WHEN q AND k THEN 'Contract:@' || substr(coalesce(contract, ''), 1, 3000) || '@@Question: ' || coalesce(question, '') || '@@' || ask
      WHEN q AND t THEN 'Text:@' || substr(coalesce(text, ''), 1, 3000) || '@@Question: ' || coalesce(question, '') || '@@' || ask
      WHEN p AND c THEN 'Policy:@' || substr(coalesce(policy, ''), 1, 3000) || '@@Claim:@' || coalesce(claim, '') || '@@' || ask
      WHEN k THEN 'Contract Scenario:@' || substr(coalesce(contract, ''), 1, 3000) || '@@' || ask
      WHEN t AND ci THEN 'Legal Statement:@' || coalesce(text, '') || '@@Citation: ' || coalesce(citation, '') || '@@' || ask
      WHEN q THEN coalesce(question, '') || '@@' || ask
      WHEN i AND t THEN 'Issue: ' || coalesce(issue, '') || '@@Fact Pattern:@' || coalesce(text, '') || '@@' || ask
      ELSE coalesce(text, '') || '@@' || ask END, '@', chr(10)) AS prompt FROM legalbench_item JOIN h USING (task) JOIN asks USING (task)"""
)
def item_prompts(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "legalbench_item")
    prompt = F.replace(scoring.item_prompt(F.col("present"), F.col("ask"), columns=_ABSENT), F.lit("@"), F.lit("\n"))  # as the SQL writes line ends
    return items.join(_present(items), "task").join(_asked(items.select("task", "item_id", "answer")), "task").select("item_id", prompt.alias("prompt"))


_Q_PASSAGE = "coalesce(contract, text, policy, question, '')"


@query(
    f"""WITH s AS (SELECT item_id, task, split, coalesce(answer, '') AS answer, {_Q_PASSAGE} AS p, 'Reply with only Yes or No.' AS ask FROM legalbench_item),
    big AS (SELECT item_id, task, split, answer, repeat(p || ' ', 40) AS p, ask FROM s)
    SELECT item_id, form, prompt, old FROM (
    SELECT item_id, 'paragraph' AS form, 'Citation: ' || task || chr(10) || chr(10) || 'Paragraph:' || chr(10) || p || chr(10) || chr(10) || ask AS prompt, chr(10) || chr(10) || ask AS old FROM s UNION ALL
    SELECT item_id, 'year', 'Year: ' || split || chr(10) || chr(10) || 'Question: ' || p || chr(10) || chr(10) || ask, p || chr(10) || chr(10) || ask FROM s UNION ALL
    SELECT item_id, 'slice', 'Context: ' || split || chr(10) || 'Text: ' || p || chr(10) || chr(10) || ask, 'Context: ' || split || chr(10) || 'Text: ' || p || chr(10) || chr(10) || 'Answer Yes or No:' FROM s UNION ALL
    SELECT item_id, 'statute', 'Statute: ' || substr(p, 1, 12000) || chr(10) || 'Description: ' || task || chr(10) || 'Question: ' || chr(10) || chr(10) || 'Text: ' || substr(answer, 1, 12000) || chr(10) || chr(10) || ask,
      'Statute: ' || p || chr(10) || 'Description: ' || task || chr(10) || 'Question: ' || chr(10) || chr(10) || 'Text: ' || answer || chr(10) || chr(10) || ask FROM big UNION ALL
    SELECT item_id, 'description', 'Policy Text:' || chr(10) || substr(p, 1, 3000) || chr(10) || chr(10) || 'Description: ' || task || chr(10) || chr(10) || ask, p || chr(10) || chr(10) || ask FROM big UNION ALL
    SELECT item_id, 'nothing', chr(10) || chr(10) || ask, chr(10) || chr(10) || ask FROM s)"""
)
def item_prompt_forms(spark: SparkSession, d: str) -> DataFrame:
    """Prompts that need columns the table lacks, in both versions: its passages, tasks, splits and answers stand in for them."""
    passage = F.coalesce("contract", "text", "policy", "question", F.lit(""))
    items = table(spark, d, "legalbench_item").select("item_id", "task", "split", F.coalesce("answer", F.lit("")).alias("label"), passage.alias("p"), F.repeat(F.concat(passage, F.lit(" ")), 40).alias("big"))
    names = ("Citation", "Paragraph", "year", "question", "slice", "text", "statute", "description")
    forms = {
        "paragraph": {"Citation": "task", "Paragraph": "p"}, "year": {"year": "split", "question": "p"}, "slice": {"slice": "split", "text": "p"},
        "statute": {"statute": "big", "description": "task", "text": "label"}, "description": {"description": "task", "text": "big"}, "nothing": {},
    }
    # name, value pairs, so that one plan writes all forms
    held = F.array(*[F.struct(F.lit(form).alias("form"), F.array(*[F.lit(n) for n in of]).cast("array<string>").alias("present"), *[(F.col(of[n]) if n in of else F.lit(None).cast("string")).alias(f"v_{n}{i}") for i, n in enumerate(names)]) for form, of in forms.items()])
    df = items.select("item_id", F.inline(held))
    columns = dict.fromkeys(("contract", "policy", "claim", "citation", "issue", *(f"choice_{i}" for i in range(5)))) | {n: f"v_{n}{i}" for i, n in enumerate(names)}
    ask = F.lit("Reply with only Yes or No.")
    return df.select("item_id", "form", scoring.item_prompt(F.col("present"), ask, columns=columns).alias("prompt"), scoring.item_prompt(F.col("present"), ask, templates=scoring.OLD_ITEM_PROMPTS, indent="  ", columns=columns).alias("old"))


@query(
    """WITH h AS (SELECT task, bool_or(choice_0 IS NOT NULL) AS c, bool_or(question IS NOT NULL) AS q, bool_or(contract IS NOT NULL) AS k FROM legalbench_item GROUP BY 1)
    SELECT item_id, CASE WHEN c THEN coalesce(question, '') || chr(10) || chr(10) || concat_ws(chr(10), '  (a) ' || choice_0, '  (b) ' || choice_1, '  (c) ' || choice_2, '  (d) ' || choice_3, '  (e) ' || choice_4)
        || chr(10) || chr(10) || 'Select the best answer by letter (a-e):'
      WHEN q AND k THEN 'Contract:' || chr(10) || substr(coalesce(contract, ''), 1, 3000) || chr(10) || chr(10) || 'Question: ' || coalesce(question, '') || chr(10) || chr(10) || 'Answer:'
      WHEN q THEN coalesce(question, '') || chr(10) || chr(10) || 'Answer:' ELSE coalesce(text, '') || chr(10) || chr(10) || 'Answer:' END AS prompt FROM legalbench_item JOIN h USING (task)"""
)
def old_item_prompts(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "legalbench_item")
    prompt = scoring.item_prompt(F.col("present"), F.lit("Answer:"), templates=scoring.OLD_ITEM_PROMPTS, indent="  ", columns=_ABSENT)
    return items.join(_present(items), "task").select("item_id", prompt.alias("prompt"))


_Q_BENCH = f"concat_ws(chr(10), {q_some('instruction')}, {q_some('question')})"


@query(f"SELECT item_id, {_Q_BENCH} AS prompt, 'You answer questions of law.' || chr(10) || chr(10) || {_Q_BENCH} AS raw, {_Q_BENCH} AS bare FROM lawbench_item")
def bench_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompt, and what is sent without a chat template, with a system text and without one."""
    prompt = scoring.bench_prompt(F.col("instruction"), F.col("question"))
    df = table(spark, d, "lawbench_item")
    return df.select("item_id", prompt.alias("prompt"), scoring.raw_prompt(prompt, F.lit("You answer questions of law.")).alias("raw"), scoring.raw_prompt(prompt, F.lit(None).cast("string")).alias("bare"))


# --- losses, tokens, vocabularies -------------------------------------------------------------------------------


@query(
    """SELECT round(avg(ln(1 + exp(-abs(x))) + greatest(-x, 0.0::DOUBLE)), 9) AS log_loss FROM (SELECT (length(response_chosen) - length(response_rejected))::DOUBLE / 50 AS x FROM preference)"""
)
def pairwise_log_loss(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "preference").select((F.length("response_chosen") / 50.0).alias("c"), (F.length("response_rejected") / 50.0).alias("r"))
    return reports.pairwise_log_loss(df, "c", "r").select(F.round("log_loss", 9).alias("log_loss"))


@query("SELECT round(avg(x * x), 9) AS mse, round(avg(abs(x)), 9) AS mae FROM (SELECT (length(response_chosen) - length(response_rejected))::DOUBLE / 50 AS x FROM preference)")
def mse_mae(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "preference").select((F.length("response_chosen") / 50.0).alias("c"), (F.length("response_rejected") / 50.0).alias("r"))
    return reports.regression_errors(df, "c", "r").select(F.round("mse", 9).alias("mse"), F.round("mae", 9).alias("mae"))


@query("SELECT round(exp(avg(length(output)::DOUBLE / 500)), 9) AS perplexity, (SELECT round(exp(sum(length(output)::DOUBLE / 500 * 512) / (count(*) * sum(length(output)))::DOUBLE), 9) FROM sft_records WHERE output IS NOT NULL) AS per_character FROM sft_records")
def perplexities(spark: SparkSession, d: str) -> DataFrame:
    df = _sft(spark, d).filter("output is not null").select("output", (F.length("output") / 500.0).alias("loss"))
    return df.agg(F.round(reports.perplexity_of(F.col("loss")), 9).alias("perplexity"), F.round(reports.padded_perplexity_of(F.col("loss"), F.col("output")), 9).alias("per_character"))


@query(
    f"""SELECT record_id, _source_file, _source_line, least(p + o, 4096) AS n_ids, greatest(least(p + o, 4096) - p, 0) AS n_labels, p >= least(p + o, 4096) AS prompt_only FROM (
    SELECT record_id, _source_file, _source_line, length(concat_ws(chr(10), {q_some('instruction')}, {q_some('input')})) AS p, length({q_clean('output')}) AS o FROM sft_records)"""
)
def mask_labels(spark: SparkSession, d: str) -> DataFrame:
    """Characters as tokens, at most 4,096 of them."""
    prompt, answer = tokenized.char_ids(text.build_text(F.col("instruction"), F.col("input"))), tokenized.char_ids(text.sanitize(F.col("output")))
    df = _sft(spark, d).select("record_id", *ROW, prompt.alias("p"), answer.alias("o"))
    m = tokenized.masked(F.concat("p", "o"), F.size("p"), 4096)
    df = df.select("record_id", *ROW, m.alias("m"), tokenized.prompt_only(F.size("p"), F.concat("p", "o"), 4096).alias("prompt_only"))
    n_labels = F.size(F.filter("m.labels", lambda x: x != tokenized.IGNORE))
    return df.select("record_id", *ROW, F.size("m.input_ids").cast("long").alias("n_ids"), n_labels.cast("long").alias("n_labels"), "prompt_only")


@query(
    r"""SELECT DISTINCT ch FROM (SELECT unnest(string_split(question, '')) AS ch FROM lawbench_item) WHERE regexp_matches(ch, '\A[\x{4e00}-\x{9fa5}]+\z')
    AND ch NOT IN (SELECT unnest(string_split(coalesce(input, ''), '')) FROM sft_records WHERE input IS NOT NULL)"""
)
def vocabulary_difference(spark: SparkSession, d: str) -> DataFrame:
    """CJK characters of the benchmark's questions that no input has."""
    one = lambda df, c: df.select(F.explode(F.array_distinct(F.split(c, ""))).alias("ch")).distinct()
    asked = one(table(spark, d, "lawbench_item"), "question").filter((F.col("ch") != "") & text.is_cjk(F.col("ch")))
    return curate.absent_from(asked, one(_sft(spark, d), "input"), ["ch"])


_Q_WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z]{{3,}}')"


@query(
    f"""WITH b AS (SELECT DISTINCT unnest({_Q_WORDS.format('text')}) AS piece FROM documents), d AS (SELECT DISTINCT unnest({_Q_WORDS.format('input')}) AS piece FROM sft_records),
    f AS (SELECT piece, count(*) AS n FROM (SELECT unnest({_Q_WORDS.format('contract')}) AS piece FROM legalbench_item) GROUP BY 1),
    t AS (SELECT piece FROM f ORDER BY n DESC, piece LIMIT 500)
    SELECT piece, 'domain' AS origin FROM d WHERE piece NOT IN (SELECT piece FROM b) UNION ALL
    SELECT piece, 'frequent' AS origin FROM t WHERE piece NOT IN (SELECT piece FROM b) AND piece NOT IN (SELECT piece FROM d)"""
)
def merged_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Words of the inputs that the documents lack, and of the commonest 500 of the contracts those that both lack."""
    words = lambda t, c: table(spark, d, t).select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("([a-z]{3,})"), 1)).alias("piece"))
    frequent = words("legalbench_item", "contract").groupBy("piece").agg(F.count(F.lit(1)).alias("freq"))
    return curate.new_vocabulary(words("documents", "text"), {"domain": words("sft_records", "input")}, frequent, 500)


@query(f"SELECT completion_id, {q_strip(chr(34) + 'cut' + chr(34))} AS cut FROM (SELECT completion_id, string_split(coalesce(content, ''), '</think>')[1] AS cut FROM completion)")
def stop_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "completion").select("completion_id", text.cut_at_stop(F.coalesce("content", F.lit("")), "</think>").alias("cut"))


@query("SELECT completion_id, string_split(string_split(string_split(coalesce(content, ''), chr(10) || chr(10) || '<answer>')[1], 'END')[1], '<answer>')[1] AS cut FROM completion")
def trimmed_stops(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "completion").select("completion_id", text.trim_stops(F.coalesce("content", F.lit("")), ["\n\n<answer>", "END"]).alias("cut"))


@query(
    f"""SELECT record_id, _source_file, _source_line FROM (SELECT *, row_number() OVER (ORDER BY _source_line) AS position FROM sft_records WHERE _source_file = 'cail2018-main_sft_00000.jsonl')
    WHERE position > 10 AND ({q_blank('reasoning')} OR {q_blank('output_model')}) ORDER BY _source_line LIMIT 50"""
)
def selected_for_generation(spark: SparkSession, d: str) -> DataFrame:
    one = _sft(spark, d).filter(F.col("_source_file") == "cail2018-main_sft_00000.jsonl")
    return generate.selected_for_generation(one, "_source_line", curate.needs_generation(), 10, 50).filter("selected").select("record_id", *ROW)


@query(f"SELECT record_id, _source_file, _source_line FROM sft_records WHERE {q_blank('reasoning')} OR {q_blank('output_model')}")
def selected_for_generation_all(spark: SparkSession, d: str) -> DataFrame:
    """In every file, with the reference's start and limit of 0: all rows that need generation."""
    return generate.selected_per_file(_sft(spark, d), "_source_file", "_source_line", curate.needs_generation(), tie=["record_id"]).filter("selected").select("record_id", *ROW)


from sieveworks import catalog_io  # noqa: E402, F401  registers its queries
