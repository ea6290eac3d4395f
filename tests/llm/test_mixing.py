import random

import pytest
from pyspark.sql import functions as F

from canopy.llm import mixing


def sized(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, lang string, tokens long")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def filled(spark, leaves, total):
    df = spark.createDataFrame([(*path, *weights, capacity) for path, weights, capacity in leaves], "d string, s string, wd double, ws double, capacity double")
    got = {(r["d"], r["s"]): r["budget"] for r in mixing.tree_budgets(df, [("d", "wd"), ("s", "ws")], total).collect()}
    return [round(got[path], 6) for path, _, _ in leaves]


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = [(("a", "x"), (0.5, 1.0), 10.0), (("a", "y"), (0.5, 1.0), 1000.0), (("b", "x"), (0.5, 1.0), 1000.0)]
    assert filled(spark, leaves, 200.0) == [10.0, 90.0, 100.0]
    leaves[1] = (("a", "y"), (0.5, 1.0), 20.0)
    assert filled(spark, leaves, 200.0) == [10.0, 20.0, 170.0]
    assert filled(spark, leaves, 9000.0) == [10.0, 20.0, 1000.0]
    assert filled(spark, [(("a", "x"), (1.0, 1.0), 5.0), (("b", "x"), (0.0, 1.0), 5.0), (("a", "y"), (1.0, 0.0), 5.0)], 9.0) == [5.0, 0.0, 0.0]
    assert filled(spark, [], 5.0) == []


def test_domains_and_languages(spark):
    s = sized(spark, [("a", "en", 90)] + [("a", "de", 10)] + [("b", "en", 100)] * 5 + [("c", "en", 100)] * 5)
    wanted = spark.createDataFrame([("a", 0.4, 1, "x"), ("b", 0.1, 1, "x"), ("c", 0.5, 1, "y")], "source string, target_share double, max_repeats int, domain string")
    got = {(r["source"], r["lang"]): round(r["budget"], 6) for r in mixing.budgets(s, wanted, 500.0).collect()}
    assert got == {("a", "en"): 90, ("a", "de"): 10, ("b", "en"): 150, ("c", "en"): 250}
    flat = {(r["source"], r["lang"]): r["budget"] for r in mixing.budgets(s, wanted.drop("domain"), 50.0).collect()}
    assert flat["a", "en"] + flat["a", "de"] == pytest.approx(20) and flat["a", "de"] > 2


@pytest.mark.parametrize("seed", range(3))
def test_shares_and_repeats(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("aaaaab"), rng.choice(["en", "de", ""]), rng.randrange(1, 60)) for _ in range(1500)] + [("small", "en", 50), ("untargeted", "en", 9)]
    wanted = targets(spark, [(" A ", 0.3, 1), ("b", 0.6, 5), ("small", 0.1, 2), ("none", 0.0, 1), ("missing", 0.01, 3)])
    s = sized(spark, rows)
    plan = mixing.budgets(s, wanted)
    mixed = mixing.mixture(s, plan).collect()
    assert {r["source"] for r in mixed} == {"a", "b", "small"} and len({r["doc_id"] for r in mixed}) == len(mixed)
    most = {"a": 1, "b": 5, "small": 2}
    assert all(1 <= r["uses"] <= most[r["source"]] for r in mixed)
    report = {r["source"]: r for r in mixing.report(mixing.mixture(s, plan), plan).collect()}
    assert report["small"]["tokens"] == 100 and report["small"]["shortage"] > 0 and report["missing"]["tokens"] == 0 and report["missing"]["actual_share"] == 0
    budget = {(r["source"], r["lang"]): r["budget"] for r in plan.collect()}
    for leaf, b in budget.items():
        got = sum(r["tokens"] * r["uses"] for r in mixed if (r["source"], r["lang"]) == leaf)
        assert abs(got - b) <= 30
    assert sum(r["actual_share"] for r in report.values()) == pytest.approx(1)
    again = sorted(map(tuple, mixing.mixture(s.repartition(9), plan).collect()))
    assert again == sorted(map(tuple, mixed))


def test_prefix_is_the_order_of_the_seeded_hash(spark):
    s = sized(spark, [("a", "", 10)] * 200)
    plan = mixing.budgets(s, targets(spark, [("a", 1.0, 2)]), 2730.0)
    got = {r["doc_id"]: r["uses"] for r in mixing.mixture(s, plan).collect()}
    order = [r["doc_id"] for r in s.orderBy(F.xxhash64("doc_id", F.lit(mixing.SEED), F.lit(1)).bitwiseXOR(F.lit(-(2**63)))).collect()]
    assert got == {d: 2 if k < 73 else 1 for k, d in enumerate(order)}


def test_empty(spark):
    s, t = sized(spark, []), targets(spark, [("a", 1.0, None), (None, 0.5, 1), ("b", None, 1)])
    plan = mixing.budgets(s, t)
    assert mixing.mixture(s, plan).count() == 0 and mixing.report(mixing.mixture(s, plan), plan).first()["actual_share"] == 0
    assert mixing.budgets(s, t.limit(0)).count() == 0


def test_documents_with_nulls_and_other_spelling_of_sources(spark):
    docs = spark.createDataFrame([(1, "two words", "en", " A"), (2, None, "en", "a"), (3, "", None, "a"), (4, "more", None, None), (5, "again", None, "a ")], "doc_id long, text string, lang string, source string")
    got = mixing.sized_documents(docs).collect()
    assert sorted((r["doc_id"], r["source"], r["lang"]) for r in got) == [(1, "a", "en"), (5, "a", "")]
