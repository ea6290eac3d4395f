import json

import pytest

from canopy import __main__ as cli
from canopy.plans import tools
from canopy.plans.engine import CollectionNotFound, Engine
from canopy.schema import RAW
from canopy.sources.store import Store
from canopy.sources.works import Snapshot
from test_engine import record


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    raw = spark.createDataFrame([record("W1", "First Paper", ["W2", "W3"]), record("W2", "Second", ["W4"]), record("W3", "Third", ["W4"]), record("W4", "Fourth", [], 9)], RAW)
    e = Engine(spark, Store(spark, str(tmp_path_factory.mktemp("store"))), Snapshot(raw))
    tools.inquire(e, "quantum", 10, name="mine")
    return e


def test_collections(engine):
    assert [c["name"] for c in tools.list_collections(engine)] == ["mine"]
    assert tools.show_collection(engine)["categories"] == {"root": 1, "trunk": 2, "leaf": 1}
    assert tools.inquire(engine, "quantum", 10)["is_new"] is False


def test_tree_search_works_and_bibtex(engine):
    top = tools.tree_of_science(engine, "root")
    assert [(w["label"][-2:], w["score"]) for w in top] == [("W4", 1.0)] and "abstract" not in top[0]
    assert "abstract" in tools.tree_of_science(engine, "root", abstracts=True)[0]
    found = tools.search(engine, "First Fourth OR", 5)
    assert found == {"nodes": [], "links": []}
    assert [n["label"][-2:] for n in tools.search(engine, "fourth", 5)["nodes"]] == ["W4"]
    got = tools.works(engine, ["W1", "none"])
    assert [w["label"][-2:] for w in got["works"]] == ["W1"] and got["not_found"] == ["none"]
    assert len(tools.bibtex(engine)["keys"]) == 4 and len(tools.bibtex(engine, preset="roots")["keys"]) == 1
    assert tools.bibtex(engine, names=["W2", "x"])["not_found"] == ["x"]
    assert [k["citekey"] for k in tools.bibtex(engine, preset="top_cited", limit=1)["keys"]] == ["lovelace2020"]


def test_exports(engine):
    whole = json.loads(tools.export_collection(engine))
    assert len(whole["nodes"]) == 4 and len(whole["links"]) == 4
    assert tools.export_collection(engine, "markdown").count("## References") == 3
    assert tools.export_collection(engine, "filename").count(".md\n") == 4
    view = tools.viewer_data(engine)
    assert not view["force"] and {round(n["size"], 3) for n in view["nodes"]} == {1.0}


@pytest.mark.parametrize(
    "call",
    [
        lambda e: tools.inquire(e, "q", 0), lambda e: tools.inquire(e, "q", 1001), lambda e: tools.inquire(e, "  "), lambda e: tools.tree_of_science(e, "crown"), lambda e: tools.tree_of_science(e, "root", 1001), lambda e: tools.search(e, " "), lambda e: tools.search(e, "x", 101),
        lambda e: tools.works(e, [" "]), lambda e: tools.bibtex(e, preset="tos", names=["a"]), lambda e: tools.bibtex(e, preset="odd"), lambda e: tools.delete_collection(e, " "), lambda e: tools.export_collection(e, "pdf"),
    ],
)
def test_wrong_arguments(engine, call):
    with pytest.raises(ValueError):
        call(engine)


def test_unknown_collection(engine):
    with pytest.raises(CollectionNotFound):
        tools.show_collection(engine, "nowhere")


def test_command_line(engine):
    run = lambda *a: cli.run(engine, cli.parser().parse_args(["--store", "x", *a]))
    assert json.loads(run("list"))[0]["name"] == "mine"
    assert run("query", "root", "--limit", "1").startswith("# Fourth")
    assert "@misc" in run("search", "second", "--format", "bibtex")
    assert json.loads(run("show", "--collection", "mine"))["work_count"] == 4 and json.loads(run("view"))["force"] is False
    assert run("export", "--format", "reference").count('"') == 8
