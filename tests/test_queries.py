"""Every query that has SQL gives what DuckDB gives; the others give rows of a stable schema."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from sieveworks import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def _rows(df):
    df = df[sorted(df.columns)]
    clean = lambda v: None if pd.isna(v) else repr(round(float(v), 9)) if isinstance(v, float) else str(v)
    return sorted((tuple(map(clean, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, str(DATA)).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.queries()[name](spark, str(DATA)).count() > 0


def test_entry_works_without_the_optional_part(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_the_optional_part():
    root = Path(catalog.__file__).parent
    for p in root.rglob("*.py"):
        if p.parent.name != "llm":
            assert "sieveworks.llm" not in p.read_text(), p


def test_filters_and_columns_reach_the_scan(spark, capsys):
    catalog.queries()["first_inconsistent"](spark, str(DATA)).explain("formatted")
    plan = capsys.readouterr().out
    schema = next(x for x in plan.splitlines() if "ReadSchema" in x)
    assert "instruction" not in schema and "input" not in schema
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_plans_have_no_cross_join(spark, name):
    plan = catalog.queries()[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
