from datetime import datetime as D

import pytest

from canopy.operators import integrity as I

T = [D(2024, m, 1) for m in range(1, 7)]
REFS = "row long, a string, b string, t timestamp"


def orphans(spark, rows, targets, **options):
    refs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], REFS)
    known = spark.createDataFrame(targets, "x string, y string, f timestamp, extra int")
    return sorted(r["row"] for r in I.orphan_references(refs, known, [("a", "x"), ("b", "y")], **options).collect())


ROWS = [("p", "q", T[0]), ("p", None, T[0]), (None, "z", T[0]), (None, None, T[0]), ("p", "z", T[0]), ("", "q", T[0]), ("p", "q", T[0])]
KNOWN = [("p", "q", T[0], 1), ("p", "q", T[3], 2), (None, "q", T[0], 3)]


@pytest.mark.parametrize("match, want", [("simple", [4]), ("full", [1, 2, 4, 5]), ("partial", [2, 4])])
def test_match_semantics(spark, match, want):
    assert orphans(spark, ROWS, KNOWN, match=match) == want


def test_time_and_nulls(spark):
    rows = [("p", "q", T[1]), ("p", "q", T[2]), ("p", "q", T[3]), ("p", "q", None)]
    assert orphans(spark, rows, [("p", "q", T[2], 1), ("p", "q", None, 1)], ref_time="t", target_time="f") == [0, 3]


def test_empty_tables(spark):
    assert orphans(spark, ROWS, [], match="partial") == [0, 1, 2, 4, 5, 6]
    assert orphans(spark, [], KNOWN) == []


def test_wrong_options(spark):
    with pytest.raises(ValueError):
        orphans(spark, ROWS, KNOWN, match="other")
    with pytest.raises(ValueError):
        orphans(spark, ROWS, KNOWN, ref_time="t")


def test_extra_columns_with_clashing_names(spark):
    refs = spark.createDataFrame([(1, "p", True, "v")], "row int, k string, is_orphan boolean, x string")
    known = spark.createDataFrame([("p", 1, "w")], "x string, row int, k string")
    assert I.orphan_references(refs, known, [("k", "x")]).count() == 0
    assert I.orphan_references(refs, known.limit(0), [("k", "x")]).first() == (1, "p", True, "v")


def test_references_of_links_and_works(spark):
    links = spark.createDataFrame([(1, "n1", "n2", T[2]), (2, "n1", None, T[2]), (3, " ", "n3", T[0]), (4, "n1", "n9", None)], "link_seq long, source_id string, target_id string, loaded_at timestamp")
    nodes = spark.createDataFrame([("n1", T[0], None), ("n2", T[0], T[1]), ("n3", T[1], None), ("n3", T[4], None)], "id string, loaded_at timestamp, removed_at timestamp")
    raw = spark.createDataFrame([(7, ["u/W1", "w1", "W1", None, "", "junk", "x:w2 ", "W1"], T[3]), (8, None, T[3])], "rec_id long, referenced_works array<string>, fetched_at timestamp")
    works = spark.createDataFrame([("https://x/W1", T[0], None), ("w2", T[5], None), (None, T[0], None)], "label string, loaded_at timestamp, removed_at timestamp")
    refs, lost = I.table_references(links, nodes, raw, works)
    got = {(r["ref_table"], r["row_id"], r["field"], r["ref_key"]) for r in lost.collect()}
    assert got == {("links", 1, "target_id", "n2"), ("links", 3, "target_id", "n3"), ("links", 4, "source_id", "n1"), ("links", 4, "target_id", "n9"), ("raw_works", 7, "referenced_works", "junk"), ("raw_works", 7, "referenced_works", "x:w2 ")}
    report = {(r["ref_table"], r["month"]): (r["refs"], r["orphans"]) for r in I.report_by_period(refs, lost, "ref_table", "ref_time").collect()}
    assert report[("links", "2024-03")] == (3, 1) and report[("raw_works", "2024-04")] == (5, 2) and report[("links", None)] == (2, 2)


def test_references_into_a_collection(spark):
    links = spark.createDataFrame([(1, "c", "n", T[2]), (2, "c", None, T[2]), (3, None, "n", T[2]), (4, None, " ", T[2]), (5, "d", "n", T[2]), (6, "d", None, T[2]), (7, "c", "n", T[0])], "link_seq long, collection_id string, target_id string, loaded_at timestamp")
    nodes = spark.createDataFrame([("n", "c", T[1], None), ("m", "d", T[1], T[1])], "id string, collection_id string, loaded_at timestamp, removed_at timestamp")
    assert sorted(r["link_seq"] for r in I.collection_references(links, nodes).collect()) == [5, 6, 7]
