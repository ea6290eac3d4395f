import pytest

from canopy.operators import dedup
from canopy.schema import WORK, WORK_COLUMNS
from canopy.sources import works as W


def works(spark, *rows):
    return spark.createDataFrame([tuple(r.get(c) for c in WORK_COLUMNS) for r in rows], WORK)


def test_shared_identifier_merges(spark):
    df = works(spark, {"label": "m-one", "ids": ["p1", "s-both"], "rich": True}, {"label": "m-two", "ids": ["p2", "s-both"], "rich": True}, {"label": "none", "ids": [], "rich": True}, {"label": "null", "ids": None, "rich": False})
    merged, members = dedup.deduplicate(df, "label")
    assert [(r["label"], r["ids"]) for r in merged.collect()] == [("m-one", ["p1", "p2", "s-both"])]
    assert sorted(tuple(r) for r in members.collect()) == [("m-one", "m-one"), ("m-two", "m-one")]


def test_merge_rules(spark):
    rows = [
        {"label": "B1", "ids": ["p1", "p2"], "authors": ["Quill"], "title": None, "year": 1999, "rich": False, "keywords": ["k2"], "permalink": "stub"},
        {"label": "Longer-B", "ids": ["p2", "p3"], "authors": ["Quill", "Rowan"], "title": "T", "year": 2000, "rich": True, "permalink": "rich"},
    ]
    m = dedup.merge_groups(works(spark, *rows).selectExpr("*", "1 as g", "label as o"), "g", "o").first()
    assert (m["label"], m["ids"], m["authors"], m["title"], m["year"], m["rich"], m["keywords"], m["permalink"]) == ("Longer-B", ["p1", "p2", "p3"], ["Quill", "Rowan"], "T", 2000, True, ["k2"], "rich")
    pair = works(spark, {"label": "B1", "ids": ["i"]}, {"label": "B2", "ids": ["i"]}).selectExpr("*", "1 as g", "label as o")
    assert dedup.merge_groups(pair, "g", "o").first()["label"] == "B1"


def test_empty(spark):
    merged, members = dedup.deduplicate(works(spark), "label")
    assert merged.count() == members.count() == 0


def test_canonical_citations(spark):
    cites = spark.createDataFrame([("a", "b", 2), ("a2", "b", 1), ("a", "gone", 0)], "src string, dst string, pos int")
    canonical = spark.createDataFrame([("a", "A"), ("a2", "A"), ("b", "B")], "id string, component string")
    assert [tuple(r) for r in dedup.canonical_citations(cites, canonical).collect()] == [("A", "B", 1)]


def test_enrich(spark):
    stubs = works(spark, {"label": "W1", "ids": ["openalex:W1"], "rich": False}, {"label": "W2", "ids": ["openalex:W2"], "rich": False}, {"label": "x", "ids": ["mag:1"], "rich": False}, {"label": "W3", "ids": ["openalex:W3"], "title": "own", "rich": True})
    fetched = works(spark, {"label": "W1", "ids": ["openalex:W1"], "title": "new", "rich": True}, {"label": "W3", "ids": ["openalex:W3"], "title": "other", "rich": True})
    assert sorted((r["label"], r["title"]) for r in dedup.enrich(stubs, fetched).collect()) == [("W1", "new"), ("W3", "own"), ("x", None)]


def test_raw_records_to_works(spark, tmp_path):
    record = """{"id":"https://openalex.org/W1","ids":{"openalex":"https://openalex.org/W1","doi":"https://doi.org/10.1/A"},"doi":"https://doi.org/10.1/A","title":"T","type":"","publication_year":2020,
    "cited_by_count":3,"referenced_works":["https://openalex.org/W2"],"authorships":[{"author":{"display_name":"Mira Quell"},"institutions":[{"display_name":"X"}]}],"keywords":[{"display_name":"b"},{"display_name":"a"}],
    "abstract_inverted_index":{"hello":[0],"world":[1]},"biblio":{"volume":"1","first_page":"2","last_page":"4"},"primary_location":{"landing_page_url":"u","source":{"display_name":"V","type":"journal","host_organization_name":"P"}}}""".replace("\n", "")
    (tmp_path / "a.json").write_text(record + '\n{"id":"https://openalex.org/W9"}\n')
    raw = W.read_raw(spark, str(tmp_path))
    w = {r["label"]: r for r in W.to_works(raw).collect()}
    full = w["https://openalex.org/W1"]
    assert full.asDict() == {
        "label": "https://openalex.org/W1", "ids": ["doi:10.1/A", "openalex:https://openalex.org/W1"], "authors": ["Quell, Mira"], "year": 2020, "title": "T", "venue": "V", "type": None, "venue_type": "journal", "publisher": "P",
        "institution": "X", "volume": "1", "issue": None, "page": "2-4", "doi": "10.1/A", "permalink": "u", "times_cited": 3, "keywords": ["a", "b"], "abstract": "hello world", "rich": True,
    }
    bare = w["https://openalex.org/W9"]
    assert bare["abstract"] == "" and bare["times_cited"] == 0 and bare["ids"] == [] and bare["rich"]
    cites = W.citations(raw)
    assert [tuple(r) for r in cites.collect()] == [("https://openalex.org/W1", "https://openalex.org/W2", 0)]
    stub = W.reference_stubs(cites).first()
    assert (stub["label"], stub["ids"], stub["rich"], stub["title"]) == ("https://openalex.org/W2", ["openalex:https://openalex.org/W2"], False, None)


def test_pages_in_order(spark, tmp_path):
    for n in (2, 1):
        (tmp_path / f"{n}.json").write_text(f'{{"meta":{{"count":3,"page":{n},"per_page":2}},"results":[{{"id":"W{n}a"}},{{"id":"W{n}b"}}]}}')
    got = W.read_pages(spark, str(tmp_path)).orderBy("page", "pos")
    assert [r["id"] for r in got.collect()] == ["W1a", "W1b", "W2a", "W2b"]


@pytest.mark.parametrize("query, limit, want", [("first, paper", 5, ["a"]), ("paper", 1, ["b"]), ("", 5, []), ("paper", 0, [])])
def test_snapshot_search(spark, query, limit, want):
    from canopy.schema import RAW

    row = lambda i, title, cited, refs: {"id": i, "title": title, "cited_by_count": cited, "referenced_works": refs, "abstract_inverted_index": {"x": [0]}}
    raw = spark.createDataFrame([row("a", "First paper", 5, ["r"]), row("b", "Second paper", 9, ["r"]), row("c", "Third paper", 1, ["r"]), row("d", "Fourth paper", 7, [])], RAW)
    assert [r["id"] for r in W.Snapshot(raw).search(query, limit).collect()] == want
