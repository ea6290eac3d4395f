import pytest
from pyspark.sql import functions as F

from canopy.operators.analysis import Analysis
from canopy.plans.engine import CollectionExists, CollectionNotFound, Engine
from canopy.schema import RAW
from canopy.sources import export
from canopy.sources.store import Store
from canopy.sources.works import Snapshot


def record(i, title, refs, cited=5, year=2020):
    url = "https://openalex.org/"
    return {
        "id": url + i, "ids": {"openalex": url + i}, "title": title, "type": "article", "publication_year": year, "cited_by_count": cited, "referenced_works": [url + r for r in refs], "authorships": [{"author": {"display_name": "Ada Lovelace"}, "institutions": []}],
        "keywords": [], "abstract_inverted_index": {"quantum": [0], "words": [1]}, "biblio": {"volume": "1", "first_page": "1", "last_page": "9"}, "locations": [],
    }


@pytest.fixture
def engine(spark, tmp_path):
    raw = spark.createDataFrame([record("W1", "First Paper", ["W2", "W3"]), record("W2", "Second", ["W4"]), record("W3", "Third", ["W4"]), record("W4", "Fourth", [], 9)], RAW)
    return Engine(spark, Store(spark, str(tmp_path / "store")), Snapshot(raw))


def test_inquire_query_search_and_delete(engine):
    first = engine.inquire("quantum words", 10, name="mine")
    assert first.is_new and first.seed_count == 3 and first.collection.work_count == 4 and first.warnings(10)
    again = engine.inquire("  QUANTUM \n words", 10)
    assert not again.is_new and again.seed_count == 0 and again.collection.id == first.collection.id and not again.warnings(10)
    id = first.collection.id
    assert engine.inquire("quantum words", 10, force=True).is_new
    with pytest.raises(CollectionExists):
        engine.inquire("other words", 10, name="mine")
    root = engine.query_category(id, "root", 5).collect()
    assert [(r["work_label"][-2:], r["score"]) for r in root] == [("W4", 1.0)]
    assert engine.query_category(id, "root", 0).count() == 0 and engine.query_category("none", "leaf", 5).count() == 0
    assert {r["work_label"][-2:] for r in engine.search(id, "First Paper", 10).nodes.collect()} == {"W1"}
    assert engine.search(id, "nonsense", 10).nodes.count() == 0 and engine.search(id, " ", 10) is None and engine.search(id, "First", 0) is None
    found, missing = engine.get_works(id, ["w3", " ", "nope", "https://openalex.org/W1", "lovelace2020", "W3"])
    assert [r["work_label"][-2:] for r in found.collect()] == ["W3", "W1"] and missing == ["nope"]
    text, infos = export.to_bibtex(engine.preset(id, "tos").withColumnRenamed("work_label", "label"))
    assert [i["citekey"] for i in infos] == ["lovelace2020", "lovelace2020a", "lovelace2020b", "lovelace2020c"] and "    pages    = {1--9}," in text
    assert engine.resolve().id == engine.resolve("mine").id == engine.resolve(id).id == id
    engine.update_name(id, None)
    with pytest.raises(CollectionNotFound):
        engine.find_by_name("mine")
    engine.delete(id)
    assert engine.list() == [] and engine.store.table("works").count() == 4 and engine.store.table("nodes").count() == 0
    with pytest.raises(CollectionNotFound):
        engine.delete(id)


def test_outdated_fingerprint_is_refreshed_in_place(engine):
    old = engine.create("quantum words", 10, "kept", version=2)
    assert engine.create("quantum words", 20).id != old.id
    broken, engine.catalogue = engine.catalogue, None
    with pytest.raises(RuntimeError):
        engine.inquire("quantum words", 10)
    assert engine.find_by_id(old.id).query_hash == old.query_hash
    engine.catalogue = broken
    new = engine.inquire("quantum words", 10)
    assert new.is_new and new.collection.id == old.id and new.collection.name == "kept" and new.collection.query_hash != old.query_hash
    with pytest.raises(CollectionExists):
        engine.create("quantum words", 20)
    with pytest.raises(ValueError):
        engine.inquire("  ", 10)


def test_persistence(engine, spark):
    id = engine.create("q", 5).id
    schema = "id string, label string, authors array<string>, ids array<string>, category string, rootness double, trunkness double, leafness double"
    rows = [("k1", "W1", ["A"], ["k1"], "root", 0.95, 0.1, 0.0), ("k2", "W2", ["B"], ["k2"], "trunk", 0.1, 0.88, 0.2), ("k3", "W3", None, ["k3"], "leaf", 0.0, 0.2, 0.92)]
    links = spark.createDataFrame([("k2", "k1", None), ("k3", "k2", 0.0), ("k3", "k2", 2.0), ("k3", "gone", 1.0)], "source string, target string, weight double")
    engine.store_analysis(id, Analysis(spark.createDataFrame(rows, schema), links))
    root = engine.query_category(id, "root").select("work_label", F.round("score", 6)).collect()
    import math

    assert [tuple(r) for r in root] == [("W1", 1.0), ("W2", round(math.log1p(0.1) / math.log1p(0.95), 6))]
    loaded = engine.load_analysis(id)
    assert sorted(tuple(r) for r in loaded.links.collect()) == [("k2", "k1", 1.0), ("k3", "k2", 2.0)]
    stub = [("k1", "W1", None, ["k1"], "root", 1.0, 0.0, 0.0), ("k2", "W2", None, ["k2"], "leaf", 0.0, 0.0, 1.0)]
    engine.store_analysis(id, Analysis(spark.createDataFrame(stub, schema), links.limit(0)))
    nodes = {r["work_label"]: r["authors"] for r in engine.load_analysis(id).nodes.collect()}
    assert nodes == {"W1": ["A"], "W2": ["B"]} and engine.find_by_id(id).work_count == 2
    with pytest.raises(CollectionNotFound):
        engine.store_analysis("none", Analysis(spark.createDataFrame(stub, schema), links))
    with pytest.raises(ValueError):
        engine.store_analysis(id, None)
    assert Store(spark, engine.store.root).table("works").count() == 3


def test_clean_again_after_misses(spark, tmp_path):
    raw = spark.createDataFrame([record("W1", "One", ["W3", "MISS"]), record("W2", "Two", ["W3"]), record("W3", "Three", [], 9), record("W4", "Four", ["MISS"])], RAW)
    engine = Engine(spark, Store(spark, str(tmp_path)), Snapshot(raw))
    id = engine.inquire("quantum", 10).collection.id
    assert sorted(r["work_label"][-2:] for r in engine.store.table("nodes", id).collect()) == ["W1", "W2", "W3"]


def test_stream_of_records_upserts_works(spark, tmp_path):
    from canopy.streaming.ingest import ingest, read_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id":"W1","ids":{"openalex":"W1"},"title":"old"}\n')
    store = Store(spark, str(tmp_path / "store"))
    run = lambda: ingest(read_stream(spark, str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in/b.json").write_text('{"id":"W1","ids":{"openalex":"W1"},"title":"new"}\n{"id":"W2"}\n')
    run()
    assert sorted((r["label"], r["title"]) for r in store.table("works").collect()) == [("W1", "new"), ("W2", None)]
