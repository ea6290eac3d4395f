import random
from datetime import datetime

import pytest

from canopy.llm import topn


def brute(rows, n):
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and s == s and s > 0:
            best.setdefault(g, []).append((-s, i))
    return sorted((g, "s", p, i) for g, items in best.items() for p, (_, i) in enumerate(sorted(items)[:n], 1))


@pytest.mark.parametrize("n", [1, 3])
@pytest.mark.parametrize("held", [1, 500_000])
def test_against_sorting(spark, monkeypatch, n, held):
    """Also with heaps that are passed on after every batch."""
    rng = random.Random(n)
    rows = [(rng.choice(["hot"] * 8 + ["b", "c", None]), f"i{k:04}", rng.choice([None, float("nan"), 0.0, -1.0, 1.0, 2.0, rng.random(), float("inf")])) for k in range(900)] + [("b", None, 5.0)]
    df = spark.createDataFrame(rows, "g0 string, id string, s double").repartition(7)
    monkeypatch.setattr(topn, "HELD", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = sorted(tuple(r) for r in topn.top_n_per_group(df, "g0", "id", ["s"], n).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows, n)


def test_ties_go_to_the_smaller_id_in_code_point_order(spark):
    df = spark.createDataFrame([("g", i, 1.0, 0.5) for i in ("b", "a", "é", "Z")], "g0 string, id string, s double, t double")
    got = [r["id"] for r in topn.top_n_per_group(df, "g0", "id", ["s", "t"], 3).where("score_name = 't'").orderBy("place").collect()]
    assert got == ["Z", "a", "b"]


def test_empty_and_wrong(spark):
    df = spark.createDataFrame([], "g0 string, id string, s double, item string, g string, m string")
    assert topn.top_n_per_group(df, "g0", "id", ["s"], 2).count() == 0
    with pytest.raises(ValueError):
        topn.top_n_per_group(df, "g0", "id", ["s"], 0)


def test_latest_rows(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t, 1, {"x": 1}), ("a", None, 9, None), ("b", None, 2, None), (None, t, 3, None), ("c", t, 1, None), ("c", t, 4, None)], "id string, at timestamp, v int, extra map<string, int>")
    assert sorted(tuple(r) for r in topn.latest_rows(df, "id", "at", ["v"]).collect()) == [("a", 1), ("b", 2), ("c", 4)]
