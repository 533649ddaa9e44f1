"""The pN queries over the smallest test tables: columns, no duplicate rows, no cross joins."""

from pathlib import Path

import pytest

from sieveworks.llm import queries as q

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")

COLUMNS = {
    "p1_found": ["record_id", "field"], "p2_found": ["record_id", "field", "defect"], "p5_found": ["record_id_a", "record_id_b"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
    "p3_selected": ["target_id", "record_id", "place"], "p6_packed": ["capacity_id", "container_id", "doc_id", "piece", "n_tokens", "start"],
    "p4_record_tokens": ["record_id", "source", "lang", "domain", "input_tokens", "reasoning_tokens", "output_tokens", "total_tokens"],
}


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, name):
    df = q.queries()[name](spark, str(DATA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rows = df.collect()
    assert rows and len(set(rows)) == len(rows)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name == "p5_found":
        assert all(r["record_id_a"] < r["record_id_b"] for r in rows)
    if name == "p2_found":
        assert {r["defect"] for r in rows} <= {"empty", "truncated", "refusal", "copy", "other_lang"}


def test_cubes_agree(spark):
    rows = lambda n: sorted(map(str, (r.asDict().items() for r in q.queries()[n](spark, str(DATA)).select("source", "lang", "domain", "level", "n_records", *q.TOKEN_MEASURES).collect())))
    assert rows("p4_token_cube") == rows("p4_maintained_cube")


def test_subset_sizes(spark):
    got = {r["target_id"]: r["count"] for r in q.p3_selected(spark, str(DATA)).groupBy("target_id").count().collect()}
    tasks = {r["task_name"]: r["count"] for r in spark.read.parquet(f"{DATA}/sft_records.parquet").dropDuplicates(["record_id"]).groupBy("task_name").count().collect()}
    for t in spark.read.parquet(f"{DATA}/sample_targets.parquet").collect():
        have = sum(tasks.values()) if t["task_name"] is None else tasks.get(t["task_name"], 0)
        assert got.get(t["target_id"], 0) == min(t["target_size"], have)
