"""Every core query against its SQL on the smallest tables."""

import os

import pytest

from canopy.plans import registry
from canopy.sources.works import work_numbers

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(value):
    if hasattr(value, "tolist") and not isinstance(value, str):
        value = value.tolist()
    if value is None or str(value) in ("NaT", "<NA>", "nan"):
        return None
    if isinstance(value, float):
        return int(value) if value == int(value) else value
    return int(value) if isinstance(value, int) else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in os.listdir(FOLDER):
        con.sql(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    got, want = registry.queries()[name](spark, FOLDER).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).count() >= 0


def test_scans_read_few_columns_and_push_filters(spark):
    raw = spark.read.parquet(f"{FOLDER}/raw_works.parquet")
    plan = work_numbers(raw)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:string,referenced_works:array<string>>" in plan
    plan = registry.queries()["upsert_nodes"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "IsNull(removed_at)" in plan.replace("isnull", "IsNull") and "PushedFilters: [IsNull(removed_at)]" in plan
