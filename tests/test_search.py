import json
import sqlite3

import pytest

from canopy.operators.search import bm25, search_collection

DOCS = [
    (1, "Citation networks of science", "We study networks, and cite them."),
    (2, "A tree of science", "The tree-of-science grows in citation data."),
    (3, "Café culture", "Nothing about graphs; naïve approach."),
    (4, None, None),
    (5, "science", "of tree " * 30),
    (6, "Networks networks networks", ""),
]


@pytest.fixture(scope="module")
def works(spark):
    return spark.createDataFrame(DOCS, "id long, title string, abstract string")


@pytest.mark.parametrize("query", ["science", "citation networks", "tree-of-science", "cafe", "naive graphs", "networking", "missing", "tree science"])
def test_bm25_as_sqlite_ranks(works, query):
    """The bundled SQLite has the same ranking function and stemmer."""
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table d using fts5(title, abstract, tokenize='porter unicode61')")
    con.executemany("insert into d(rowid, title, abstract) values (?, ?, ?)", DOCS)
    phrases = " ".join('"' + p + '"' for p in query.split())
    want = dict(con.execute("select rowid, bm25(d) from d where d match ?", (phrases,)).fetchall())
    got = {r["id"]: r["score"] for r in bm25(works, "id", query).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-6)


def test_blank_query_and_no_works(works):
    assert bm25(works, "id", ' " ').count() == 0
    assert bm25(works.where("id < 0"), "id", "science").count() == 0


def test_ranks_over_all_works_then_keeps_the_collection(spark, works):
    named = works.selectExpr("cast(id as string) as label", "title", "abstract")
    nodes = spark.createDataFrame([("2",), ("5",)], "work_label string")
    assert [r["label"] for r in search_collection(named, nodes, "science", 1).collect()] == ["2"]
    assert search_collection(named, nodes, "science", 0).count() == 0


FIELD_DOCS = [
    (1, "Networks", "Graphs of papers.", ["citation analysis", "trees"], ["Ada Network", "B. Roe"]),
    (2, "Citation networks", None, [], ["C. Poe"]),
    (3, None, None, ["citation"], None),
    (4, "Other matter", "Nothing here.", None, ["Citation, D."]),
]


@pytest.mark.parametrize("query", ["citation", "citation networks", "ada-network", "analysis-trees", "trees-citation"])
def test_all_four_fields_are_ranked_as_sqlite_ranks(spark, tmp_path, query):
    """The works that the registered queries hand the operator, with lists as JSON text."""
    from canopy.plans import catalog

    spark.createDataFrame(FIELD_DOCS, "work_id long, title string, abstract string, keywords array<string>, authors array<string>").write.parquet(str(tmp_path / "works.parquet"))
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table d using fts5(title, abstract, keywords, authors, tokenize='porter unicode61')")
    con.executemany("insert into d(rowid, title, abstract, keywords, authors) values (?, ?, ?, ?, ?)", [(i, t, a, *[None if x is None else json.dumps(x) for x in rest]) for i, t, a, *rest in FIELD_DOCS])
    want = dict(con.execute("select rowid, bm25(d) from d where d match ?", (" ".join('"' + p + '"' for p in query.split()),)).fetchall())
    got = {r["work_id"]: r["score"] for r in bm25(catalog._documents(spark, str(tmp_path)), "work_id", query).collect()}
    assert got == pytest.approx(want, rel=1e-6)


def test_registered_search_finds_keywords_and_authors(spark, tmp_path):
    from canopy.plans import catalog

    spark.createDataFrame(FIELD_DOCS, "work_id long, title string, abstract string, keywords array<string>, authors array<string>").write.parquet(str(tmp_path / "works.parquet"))
    assert {r["work_id"] for r in catalog.bm25_search_all_fields(spark, str(tmp_path)).collect()} == {1}
    terms = {r["term"]: (r["works"], r["uses"]) for r in catalog.words_index_all_fields(spark, str(tmp_path)).collect()}
    assert terms["citation"] == (4, 4) and terms["roe"] == (1, 1)
