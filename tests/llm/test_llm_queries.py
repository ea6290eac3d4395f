"""The pN_ queries on the smallest tables: columns, types, and SQL where there is one."""

import os

import pytest

from canopy.llm import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

COLUMNS = {
    "p1_found": ["name_a", "name_b"], "p2_found": ["field", "work_a", "work_b"], "p4_found": ["group_id", "field", "work_id"], "p5_found": ["work_id", "group_id"],
    "p6_found": ["collection_id", "score_name", "place", "node_id"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_runs(spark, name):
    df = registry.queries()[name](spark, FOLDER)
    if name in COLUMNS:
        assert sorted(df.columns) == sorted(COLUMNS[name])
    rows = df.collect()
    assert rows
    if name == "p6_found":
        assert dict(df.dtypes)["place"] == "bigint" and max(r["place"] for r in rows) <= 10
    if name == "p1_found":
        assert all(r["name_a"] < r["name_b"] for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.sql(f"create view {file.split('.')[0]} as select * from '{FOLDER}/{file}'")
    want = con.sql(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, FOLDER).select(*want.columns)
    assert sorted(tuple(r) for r in df.collect()) == sorted(want.fetchall())


def test_core_does_without_this_package():
    """Nothing outside imports it, but for the entry file, which may do without."""
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parent.parent.parent
    for path in (root / "canopy").rglob("*.py"):
        if "llm" not in path.relative_to(root / "canopy").parts:
            assert not re.search(r"canopy\.llm|from \.llm|import llm", path.read_text()), path
