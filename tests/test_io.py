"""Sources, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from sieveworks.runtime import checkpoint_dir, cut_lineage, ship_code
from sieveworks.sources import jsonl, paths, sinks, tables
from sieveworks.streaming import curation

LINES = ['{"a": "x", "b": [1, 2]}', "", '{"a": null}', '{"a": 1} tail', "[1]", "{'a': 1}", '{"b": {"c": "法"}}', "   "]


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.jsonl").write_text("\n".join(LINES) + "\n", encoding="utf-8")
    (tmp_path / "in" / "two.jsonl").write_text("\n".join('{"a": "%d"}' % i for i in range(2000)), encoding="utf-8")
    return tmp_path


def test_json_lines(spark, folder):
    one = str(folder / "in" / "one.jsonl")
    rows = jsonl.read_records(spark, one, ["a", "b"]).orderBy("_source_line").collect()
    assert [(r["_source_line"], r["a"], r["b"]) for r in rows] == [(1, "x", "[1, 2]"), (3, None, None), (7, None, '{"c": "法"}')]
    counts = {r["status"]: r["n"] for r in jsonl.read_records(spark, one, ["a"], "count").collect()}
    assert counts == {"ok": 3, "invalid": 2, "not_object": 1}
    assert jsonl.read_records(spark, one, ["a"], "keep").count() == 6
    with pytest.raises(Exception, match="bad JSON line"):
        jsonl.read_records(spark, one, ["a"], "fail").collect()
    with pytest.raises(ValueError):
        jsonl.read_records(spark, one, ["a"], "other")


def test_line_numbers_over_splits(spark, folder):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = jsonl.read_records(spark, str(folder / "in" / "two.jsonl"), ["a"]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["_source_line"], int(r["a"])) for r in got) == [(i + 1, i) for i in range(2000)]


def test_json_documents(spark, tmp_path):
    assert jsonl.extract_records('[1, {"a": 2}]') == [1, {"a": 2}] and jsonl.extract_records('{"d": [3]}', "d") == [3] and jsonl.extract_records('{"d": 1}') == [{"d": 1}] and jsonl.extract_records("1\n2") == [1, 2]
    for bad in ("", '"text"', "{'a'"):
        with pytest.raises(ValueError):
            jsonl.extract_records(bad)
    with pytest.raises(ValueError):
        jsonl.extract_records('{"d": 1}', "d")
    (tmp_path / "x.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert jsonl.read_documents(spark, str(tmp_path / "x.json")).count() == 2


def test_paths(folder):
    d = folder / "s"
    d.mkdir()
    for n in ("train.jsonl", "validation.jsonl", "metadata.json", "a_metadata.json", "other.jsonl", "eval_x.json"):
        (d / n).write_text("")
    assert [p.split("/")[-1] for p in paths.for_split(str(d), "train")] == ["train.jsonl"]
    (d / "train.jsonl").unlink()
    assert [p.split("/")[-1] for p in paths.for_split(str(d), "train")] == ["other.jsonl"]
    assert [p.split("/")[-1] for p in paths.for_split(str(d), "validation")] == ["validation.jsonl"]
    assert paths.split_by_name(["a/valid.json", "b/Test.json"]) == {"train": ["a/valid.json", "b/Test.json"], "validation": ["a/valid.json"], "test": ["b/Test.json"]}
    assert len(paths.listed(f"{folder / 'in'}, {folder / 'in' / 'one.jsonl'}")) == 2
    assert [p.split("/")[-1] for p in paths.json_then_jsonl(str(d))][0].endswith(".json")
    with pytest.raises(FileNotFoundError):
        paths.listed(str(folder / "none"))
    assert paths.output_path("x/a.json", str(folder)) == str(folder / "a.jsonl") and paths.output_path("a.json", "b/c.txt") == "b/c.jsonl"


def test_tables(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('q\t"x\ta\n')
    assert [tuple(r) for r in tables.tsv(spark, str(tmp_path / "t.tsv")).collect()] == [("q", '"x', "a")]
    (tmp_path / "s.csv").write_text("task,model_name,score,abstention_rate\n1-1,m,0.5,0.25\n")
    assert tables.score_csv(spark, str(tmp_path / "s.csv")).first()["score"] == 0.5
    (tmp_path / "1-1.json").write_text('[{"a": 1}, {"a": 2}]')
    assert [tuple(r) for r in tables.item_counts(spark, str(tmp_path / "1-1.json")).collect()] == [("1-1", 2)]
    (tmp_path / "v.txt").write_text("法律 12\n\n word\n")
    assert [tuple(r) for r in tables.vocabulary(spark, str(tmp_path / "v.txt")).collect()] == [("法律", 12), ("word", None)]
    for t, line in (("hearsay", '{"text": "a"}'), ("scalr", '{"question": "q"}')):
        (tmp_path / "tasks" / t).mkdir(parents=True)
        (tmp_path / "tasks" / t / "test.jsonl").write_text(line)
    assert sorted((r["task"], r["text"], r["question"]) for r in tables.task_folders(spark, str(tmp_path / "tasks")).collect()) == [("hearsay", "a", None), ("scalr", None, "q")]
    assert [r["text"] for r in tables.text_lines(spark, str(tmp_path / "v.txt")).collect()] == ["法律 12", "", "word"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "法", "train"), (2, None, "validation")], "k long, t string, split string")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"k":1,"t":"法","split":"train"}', '{"k":2,"t":null,"split":"validation"}']
    sinks.write_jsonl(df.select("t"), str(tmp_path / "e"), ascii_only=True)
    assert '{"t": "\\u6cd5"}' in [r["value"] for r in spark.read.text(str(tmp_path / "e")).collect()]
    sinks.write_by(df, str(tmp_path / "b"), "split")
    assert (tmp_path / "b" / "split=train").is_dir()
    sinks.write_json_array(df.orderBy("k"), str(tmp_path / "a.json"))
    assert [r["k"] for r in json.loads((tmp_path / "a.json").read_text())] == [1, 2]
    sinks.write_indexed(df, str(tmp_path / "i.json"), ["k"])
    assert json.loads((tmp_path / "i.json").read_text())["1"]["k"] == 2
    sinks.write_report({"n": 2}, df.orderBy("k"), str(tmp_path / "r"))
    assert "| k | t | split |" in (tmp_path / "r.md").read_text()
    for _ in range(2):
        sinks.replace_folder(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.write_lines(spark.createDataFrame([("raw",)], "value string"), str(tmp_path / "l"))
    with pytest.raises(ValueError):
        sinks.small_rows(spark.range(5), 4)


def test_streams(spark, tmp_path):
    schema = "record_id long, instruction string, input string, output string, source string, _source_file string, at timestamp"
    rows = [(i % 6, "请写一份案情摘要" if i != 4 else None, "x", "y", "s", "f.jsonl", None) for i in range(8)]
    spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("record_id"))).write.parquet(str(tmp_path / "in"))
    seen = []
    once = curation.delivered_once(curation.read_folder(spark, str(tmp_path / "in"), schema), "record_id", "at")
    q = curation.run_batches(curation.curated(once), lambda b, n: seen.extend(b.select("record_id", "task_name").collect()), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert sorted(r["record_id"] for r in seen) == [0, 1, 2, 3, 5] and {r["task_name"] for r in seen} == {"case_summary"}
    counts = curation.arrivals(curation.read_folder(spark, str(tmp_path / "in"), schema), "at", "source")
    assert counts.isStreaming and counts.columns == ["start", "source", "n"]


def test_checkpoints_go_where_the_session_says(spark):
    assert cut_lineage(spark.range(3)).count() == 3
    assert checkpoint_dir(spark) == checkpoint_dir(spark)


def test_code_is_shipped_through_the_shared_folder(spark):
    where = ship_code(spark)
    assert where.startswith(checkpoint_dir(spark))
    assert spark.range(2).count() == 2


def test_pipelines(spark, tmp_path):
    from sieveworks.plans import curation as plan
    from sieveworks.plans import evaluation

    rows = [(i, "请写一份案情摘要" if i % 3 else "选择题：选出正确的一项", f"案情{i}" * 40, "答" if i != 5 else " ", "s", "f.jsonl") for i in range(60)]
    df = spark.createDataFrame(rows, "record_id long, instruction string, input string, output string, source string, _source_file string")
    parts = plan.prepared(df)
    counts = {r["task_name"]: (r["n_before"], r["n_train"], r["n_validation"]) for r in plan.prepared_counts(*parts).collect()}
    assert counts == {"case_summary": (37, 26, 2), "mcq": (19, 37, 1)}
    plan.write_prepared(str(tmp_path / "out"), *parts)
    assert spark.read.json(str(tmp_path / "out" / "train")).count() == 63 and json.loads((tmp_path / "out" / "metadata.json").read_text())["mcq"]["n_train"] == 37
    thin = plan.thinned(df.withColumn("input", F.concat("input", F.sha2(F.col("record_id").cast("string"), 512))), "record_id", 4)
    assert thin.filter("_sampled = 'selected'").count() == min(4, thin.count()) > 0
    items = spark.createDataFrame([(1, "t", "Yes", None), (2, "t", "No", None), (3, "c", "b", "x")], "item_id long, task string, answer string, choice_0 string")
    predictions = spark.createDataFrame([(1, "m", "t", "Yes", "<think>no</think> yes"), (2, "m", "t", "No", None), (3, "m", "c", "b", "1")], "item_id long, model_name string, task string, truth string, prediction_raw string")
    scores = evaluation.scored(predictions, items)
    assert {r["item_id"]: r["correct"] for r in scores.collect()} == {1: True, 2: False, 3: True}
    evaluation.write_report(scores, str(tmp_path / "report"))
    assert "| m | t | 2 | 1 | 50.0 |" in (tmp_path / "report.md").read_text() and (tmp_path / "report_responses" / "task=t").is_dir()
