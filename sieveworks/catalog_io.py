"""Queries of sources and sinks: each writes whole tables to the session's shared folder and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.catalog import ROW, q_blank, q_clean, query
from sieveworks.operators import curate, dialog, reports
from sieveworks.runtime import checkpoint_dir, table
from sieveworks.sources import files, jsonl, paths, sinks, tables


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/sieveworks_io_{uuid.uuid4().hex}"


_FIELDS = ("record_id", "id", "instruction", "input", "reasoning", "output")


@query("SELECT record_id::VARCHAR AS record_id, id, instruction, input, reasoning, output FROM sft_records")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Records as JSON lines, listed and strictly read again."""
    at = _folder(spark)
    sinks.write_jsonl(table(spark, d, "sft_records").select(*_FIELDS), at)
    return jsonl.read_records(spark, paths.listed(at, (".txt",)), _FIELDS, "fail").select(*_FIELDS)


@query("SELECT record_id::VARCHAR AS record_id, input FROM sft_records WHERE length(coalesce(input, '')) >= 100")
def kept_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of long enough records, written as they were read, in ASCII."""
    at = _folder(spark)
    sinks.write_jsonl(table(spark, d, "sft_records").select("record_id", "input"), f"{at}/in", ascii_only=True)
    read = jsonl.read_records(spark, f"{at}/in", ["record_id", "input"], "keep")
    sinks.write_lines(read.filter(F.length("input") >= 100), f"{at}/out")
    return jsonl.read_records(spark, f"{at}/out", ["record_id", "input"]).select("record_id", "input")


@query(
    """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN output IS NULL THEN 'invalid_json' WHEN output_model IS NULL THEN 'not_object' WHEN instruction IS NULL OR input IS NULL
      THEN 'missing_fields:' || concat_ws(',', CASE WHEN instruction IS NULL THEN 'instruction' END, CASE WHEN input IS NULL THEN 'input' END)
      WHEN """ + " OR ".join(q_blank(c) for c in ("instruction", "input", "output")) + """ THEN 'empty_required_field' WHEN reasoning IS NULL THEN 'tokenize_error'
      WHEN length(input) >= length(input) + length(output) - 4 THEN 'truncated_prompt_only' ELSE 'ok' END AS reason FROM sft_records) GROUP BY 1"""
)
def precheck_lines(spark: SparkSession, d: str) -> DataFrame:
    """All reasons, over lines of which those without an output are broken and those without a model output are lists; characters stand for tokens."""
    at, names = _folder(spark), ("instruction", "input", "output", "reasoning")
    line = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    line = F.when(F.col("output").isNull(), F.concat(line, F.lit(" tail"))).when(F.col("output_model").isNull(), F.concat(F.lit("["), line, F.lit("]"))).otherwise(line)
    sinks.write_lines(table(spark, d, "sft_records").select(line.alias("value")), at)
    read = jsonl.read_records(spark, at, names, "keep")
    prompt = F.when(F.col("reasoning").isNotNull(), F.length("input"))
    reason = curate.precheck_reason(("instruction", "input", "output"), prompt, prompt + F.length("output") - 4, F.col("status"))
    return read.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'ok' AS status, count(*) AS n FROM sft_records UNION ALL SELECT 'invalid', count(*) FILTER (output IS NULL) FROM sft_records HAVING count(*) FILTER (output IS NULL) > 0")
def counted_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines by what they are: each record, and a broken line for each without an output."""
    at = _folder(spark)
    df = table(spark, d, "sft_records")
    whole = df.select(F.to_json(F.struct("record_id", "input")).alias("value"))
    sinks.write_lines(whole.unionAll(df.filter("output is null").select(F.lit("{'a': 1}").alias("value"))), at)
    return jsonl.read_records(spark, at, ["record_id"], "count")


@query("SELECT item_id, task, answer FROM legalbench_item")
def json_array_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Items as one array, and read as a document."""
    at = _folder(spark)
    sinks.write_json_array(table(spark, d, "legalbench_item").select("item_id", "task", "answer"), f"{at}/items.json")
    got = jsonl.read_documents(spark, f"{at}/items.json")
    return got.select(F.from_json("record", "item_id long, task string, answer string").alias("r")).select("r.*")


@query("SELECT task, count(*) AS n FROM lawbench_item GROUP BY 1")
def item_counts(spark: SparkSession, d: str) -> DataFrame:
    """Items of a file with an array for each task."""
    at, items = _folder(spark), table(spark, d, "lawbench_item")
    for r in items.select("task").distinct().collect():  # a file each
        sinks.write_json_array(items.filter(F.col("task") == r["task"]), f"{at}/{r['task']}.json")
    return tables.item_counts(spark, at)


@query("SELECT item_id, task, answer FROM legalbench_item")
def task_folders(spark: SparkSession, d: str) -> DataFrame:
    """One folder for each task, named by it."""
    at = _folder(spark)
    df = table(spark, d, "legalbench_item").select("item_id", "task", "answer")
    sinks.write_by(df, at, "task", plain=True)
    for name in files.folders(at):
        for f in files.entries(f"{at}/{name}"):
            if f.endswith(".json"):
                files.move(f, f"{f}l")
    return tables.task_folders(spark, at).select("item_id", "task", "answer")


_Q_FLAT = r"regexp_replace(coalesce({0}, ''), '[\x09-\x0d\x{{85}}\x{{2028}}\x{{2029}}]+', ' ', 'g')"


@query(f"SELECT nullif({_Q_FLAT.format('instruction')}, '') AS instruction, nullif({_Q_FLAT.format('question')}, '') AS input, nullif({_Q_FLAT.format('answer')}, '') AS output FROM lawbench_item")
def tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Items as tab-separated lines."""
    at = _folder(spark)
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x09-\x0d\x{85}\x{2028}\x{2029}]+", " ")
    df = table(spark, d, "lawbench_item").select(F.concat_ws("\t", flat("instruction"), flat("question"), flat("answer")).alias("value"))
    sinks.write_lines(df, at)
    return tables.tsv(spark, at).select(*[F.nullif(c, F.lit("")).alias(c) for c in ("instruction", "input", "output")])


@query(
    """SELECT task, model_name, round(count(*) FILTER (coalesce(matched, false))::DOUBLE / count(*)::DOUBLE, 6) AS score, round(count(*) FILTER (coalesce(prediction_extracted, '') = '')::DOUBLE / count(*)::DOUBLE, 6) AS abstention_rate
    FROM (SELECT DISTINCT * FROM prediction) GROUP BY 1, 2"""
)
def score_csv(spark: SparkSession, d: str) -> DataFrame:
    at, n = _folder(spark), F.count(F.lit(1)).cast("double")
    scores = table(spark, d, "prediction").distinct().groupBy("task", "model_name").agg(
        F.round(F.count_if(F.coalesce("matched", F.lit(False))) / n, 6).alias("score"), F.round(F.count_if(F.coalesce("prediction_extracted", F.lit("")) == "") / n, 6).alias("abstention_rate")
    )
    scores.write.option("header", True).csv(at)
    return tables.score_csv(spark, at)


@query("SELECT trim(x) AS text, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(text, '[\\x09\\x{a0}\\x{3000}\\r]+', ' ', 'g'), chr(10))) AS x FROM documents WHERE text IS NOT NULL AND text <> '') GROUP BY 1")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of all documents, stripped."""
    at = _folder(spark)
    sinks.write_lines(table(spark, d, "documents").filter("text <> ''").select(F.regexp_replace("text", r"[\t\x{a0}\x{3000}\r]+", " ").alias("text")), at, "text")
    return tables.text_lines(spark, at).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT w AS word, CASE WHEN count(*) > 1 THEN count(*)::DOUBLE END AS freq FROM (SELECT unnest(regexp_extract_all(lower(coalesce(contract, '')), '[a-z]{3,}')) AS w FROM legalbench_item) GROUP BY 1")
def vocabulary_lines(spark: SparkSession, d: str) -> DataFrame:
    """Words of the contracts with their frequency, without it where it is one; as doubles, which compare alike in all clients."""
    at = _folder(spark)
    words = table(spark, d, "legalbench_item").select(F.explode(F.regexp_extract_all(F.lower(F.coalesce("contract", F.lit(""))), F.lit("([a-z]{3,})"), 1)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    sinks.write_lines(words.select(F.concat_ws(" ", "w", F.when(F.col("n") > 1, F.col("n").cast("string"))).alias("value")), at)
    return tables.vocabulary(spark, at).select("word", F.col("freq").cast("double").alias("freq"))


@query("SELECT row_number() OVER (ORDER BY item_id) - 1 AS place, item_id, answer FROM lawbench_item")
def indexed_rows(spark: SparkSession, d: str) -> DataFrame:
    at = _folder(spark)
    sinks.write_indexed(table(spark, d, "lawbench_item").select("item_id", "answer"), f"{at}/all.json", ["item_id"])
    got = jsonl.read_documents(spark, f"{at}/all.json").select(F.explode(F.from_json("record", "map<string, struct<item_id: long, answer: string>>")).alias("place", "r"))
    return got.select(F.col("place").cast("long").alias("place"), "r.*")


@query("SELECT pair_id, coalesce(question, '') AS question FROM preference WHERE system IS NOT NULL")
def replaced_folder(spark: SparkSession, d: str) -> DataFrame:
    """A folder read and replaced by a part of itself, twice."""
    at = _folder(spark)
    sinks.replace_folder(table(spark, d, "preference").select("pair_id", "system", "question"), at)
    sinks.replace_folder(spark.read.parquet(at).filter("system is not null"), at)
    return spark.read.parquet(at).select("pair_id", F.coalesce("question", F.lit("")).alias("question"))


@query("SELECT DISTINCT record_id FROM sft_records")
def resumed_output(spark: SparkSession, d: str) -> DataFrame:
    """Records with an output, then all: what the folder has is not written again."""
    at, df = _folder(spark), table(spark, d, "sft_records").select("record_id", "output")
    sinks.append_unfinished(df.filter("output is not null").select("record_id"), at, "record_id")
    sinks.append_unfinished(df.select("record_id"), at, "record_id")
    return spark.read.parquet(at)


@query("SELECT CASE WHEN lang = 'en' THEN 'selected' ELSE 'remaining' END AS kind, count(*) AS n FROM documents GROUP BY 1")
def selection_folders(spark: SparkSession, d: str) -> DataFrame:
    """Selected and remaining rows in folders that are named by their sizes."""
    at = _folder(spark)
    flag = F.when(F.col("lang") == "en", "selected").otherwise("remaining")
    sinks.write_selection(table(spark, d, "documents").select("doc_id", flag.alias("_sampled")), at)
    names = spark.createDataFrame([(n,) for n in files.folders(at)], "name string")
    return names.select(F.split("name", "_")[0].alias("kind"), F.split("name", "_")[1].cast("long").alias("n")).filter("n > 0")


@query("SELECT * FROM (VALUES ('train.jsonl', 'train'), ('validation.jsonl', 'validation')) AS t(name, split)")
def files_of_splits(spark: SparkSession, d: str) -> DataFrame:
    """Files that a folder has for each split: those named for it, never metadata."""
    at = _folder(spark)
    for name in ("train.jsonl", "validation.jsonl", "other.jsonl", "metadata.json"):
        files.write_text(f"{at}/{name}", "{}\n")
    rows = [(f.rsplit("/", 1)[-1], split) for split in ("train", "validation") for f in paths.for_split(at, split)]
    return spark.createDataFrame(rows, "name string, split string")


@query("SELECT _source_file, count(*) AS n, count(*) AS changed FROM sft_records GROUP BY 1")
def changed_by_cleaning(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "sft_records")
    return df.groupBy("_source_file").agg(F.count(F.lit(1)).alias("n"), F.count_if(curate.has_provenance(df)).alias("changed"))


@query(f"SELECT record_id, _source_file, _source_line, CASE WHEN {q_blank('system_prompt')} THEN 'Answer.' ELSE {q_clean('system_prompt')} END AS system, CASE WHEN coalesce(system_prompt, '') = '' THEN 'Answer.' ELSE {q_clean('system_prompt')} END AS kept FROM sft_records")
def system_texts(spark: SparkSession, d: str) -> DataFrame:
    own = F.col("system_prompt")
    return table(spark, d, "sft_records").select("record_id", *ROW, curate.system_text(own, " Answer. ").alias("system"), curate.system_text(own, "Answer.", False).alias("kept"))


@query("SELECT pair_id, length(coalesce(question, '')) + length(coalesce(response_chosen, '')) + length(coalesce(system, '')) + 2 * len(coalesce(history, [])) AS n, coalesce(response_chosen, '') AS chosen, coalesce(response_rejected, '') AS rejected FROM preference WHERE coalesce(question, '') <> ''")
def preference_texts(spark: SparkSession, d: str) -> DataFrame:
    """Both dialogs of a pair end with its answers, and differ in them alone."""
    plain = dialog.Template("", "{query}\n", "")
    empty = F.transform("history", lambda p: F.array(F.lit(""), F.lit("")))
    df = curate.not_empty(table(spark, d, "preference"), "question").withColumn("history", empty).withColumn("t", dialog.preference_texts(plain))
    ends = lambda c, k: F.substring(F.col(f"t.{c}"), F.length(f"t.{c}") - F.length(F.coalesce(k, F.lit(""))) + 1, 1 << 30)
    lines = F.length("t.chosen") - F.length(F.replace("t.chosen", F.lit("\n"), F.lit("")))
    n = F.length("question") + F.length(F.coalesce("response_chosen", F.lit(""))) + F.length(F.coalesce("system", F.lit(""))) + 2 * F.size(F.coalesce("history", F.array().cast("array<array<string>>")))
    return df.filter(lines >= 1).select("pair_id", n.cast("long").alias("n"), ends("chosen", "response_chosen").alias("chosen"), ends("rejected", "response_rejected").alias("rejected"))


@query(
    f"""SELECT count(*) AS scanned, count(*) FILTER (length(coalesce(input, '')) >= 100) AS retained, count(*) FILTER (length(coalesce(input, '')) < 100) AS dropped, count(DISTINCT _source_file) AS files,
    count(*) FILTER ({q_blank('reasoning')} OR {q_blank('output_model')}) AS selected FROM sft_records"""
)
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    return reports.run_counters(table(spark, d, "sft_records"), {"retained": F.length(F.coalesce("input", F.lit(""))) >= 100, "dropped": F.length(F.coalesce("input", F.lit(""))) < 100, "selected": curate.needs_generation()}, "_source_file")
