"""Thin, validated entry points over the engine that return plain data for a caller outside Spark.

Every function checks its arguments before a plan is built, and collects bounded results
only: a listing, a category list, a search result, or the works that were asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from canopy.operators import analysis as A
from canopy.plans.engine import PRESETS, Engine, check_limit
from canopy.sources import export

#: Parameters: defaults and bounds of limits.
INQUIRE, SEARCH, LIST = (200, 1000), (10, 100), (20, 1000)
# The columns that summaries show.
WORK_SUMMARY = ["label", "ids", "authors", "year", "title", "venue", "volume", "issue", "page", "doi", "permalink", "times_cited", "keywords", "abstract"]
NODE_METADATA = ["id", "label", "category", "rootness", "trunkness", "leafness", "rich", "title", "year", "venue", "volume", "issue", "page", "doi", "permalink", "times_cited", "authors", "ids"]


def collection_summary(row: Row) -> dict:
    """A stored collection for display; a null name is ''."""
    return {"id": row["id"], "name": row["name"] or "", "query": row["query"], "limit": row["result_limit"], "work_count": row["work_count"], "created_at": row["created_at"].isoformat(), "updated_at": row["updated_at"].isoformat()}


def work_summaries(works: DataFrame, abstracts: bool = True) -> DataFrame:
    """The summary columns of works; without abstracts the column is null and never read."""
    label = "label" if "label" in works.columns else "work_label"
    columns = [F.col(label).alias("label") if c == "label" else F.lit(None).cast("string").alias(c) if c == "abstract" and not abstracts else F.col(c) for c in WORK_SUMMARY]
    return works.select(*columns)


def node_metadata(nodes: DataFrame) -> DataFrame:
    """The metadata of nodes with their works, for front matter."""
    return nodes.withColumnRenamed("work_label", "label").select(*NODE_METADATA)


def _plain(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def list_collections(engine: Engine) -> list[dict]:
    return [collection_summary(r) for r in engine.list()]


def show_collection(engine: Engine, target: str = "") -> dict:
    """A collection and how many works of each category it has."""
    row = engine.resolve(target)
    counts = engine.store.table("nodes", row["id"]).groupBy("category").count().collect()  # at most four categories
    return collection_summary(row) | {"categories": {r["category"] or "none": r["count"] for r in counts}}


def inquire(engine: Engine, query: str, limit: int = INQUIRE[0], force: bool = False, name: str | None = None) -> dict:
    check_limit(limit, INQUIRE[1])
    done = engine.inquire(query, limit, force, name)
    return {"collection": collection_summary(done.collection), "is_new": done.is_new, "seed_count": done.seed_count, "warnings": done.warnings(limit)}


def delete_collection(engine: Engine, target: str) -> dict:
    """Delete the named collection; unlike for other tools the target must be given."""
    if not target.strip():
        raise ValueError("a collection must be named")
    row = engine.resolve(target)
    engine.delete(row["id"])
    return collection_summary(row)


def tree_of_science(engine: Engine, category: str, limit: int = LIST[0], target: str = "", abstracts: bool = False) -> list[dict]:
    """The best works of root, trunk or leaf with their scores, without abstracts unless asked for."""
    if category not in A.SCORES:
        raise ValueError(f"category must be one of {tuple(A.SCORES)}")
    check_limit(limit, LIST[1])
    top = engine.query_category(engine.resolve(target)["id"], category, limit)
    return _plain(top.withColumnRenamed("work_label", "label").select("score", *[c for c in WORK_SUMMARY if abstracts or c != "abstract"]))


def search(engine: Engine, query: str, limit: int = SEARCH[0], target: str = "") -> dict:
    """Matches and what connects them: nodes with metadata, and links."""
    if not query.strip():
        raise ValueError("query must not be empty")
    check_limit(limit, SEARCH[1])
    found = engine.search(engine.resolve(target)["id"], query, limit)
    return {"nodes": _plain(node_metadata(found.nodes)) if found else [], "links": _plain(found.links) if found else []}


def works(engine: Engine, names: list[str], target: str = "") -> dict:
    if not [n for n in names if n.strip()]:
        raise ValueError("at least one work must be named")
    found, missing = engine.get_works(engine.resolve(target)["id"], names)
    return {"works": _plain(work_summaries(found)), "not_found": missing}


def bibtex(engine: Engine, preset: str | None = None, names: list[str] | None = None, limit: int = LIST[0], target: str = "", abstracts: bool = True) -> dict:
    """BibTeX of a preset or of named works, which exclude each other (by default the preset tos)."""
    if preset and names:
        raise ValueError("give a preset or names, not both")
    if preset and preset not in PRESETS:
        raise ValueError(f"preset must be one of {PRESETS}")
    check_limit(limit, LIST[1])
    id, missing = engine.resolve(target)["id"], []
    if names:
        chosen, missing = engine.get_works(id, names)
    else:
        chosen = engine.preset(id, preset or "tos", limit)
    text, keys = export.to_bibtex(chosen.withColumnRenamed("work_label", "label"), abstracts)
    return {"bibtex": text, "keys": keys, "not_found": missing}


def export_collection(engine: Engine, format: str = "json", target: str = "") -> str:
    """A whole collection as text: its nodes with links for json and markdown, else its works.

    For one collection that a person reads; write_json exports tables of any size.
    """
    analysis = engine.load_analysis(engine.resolve(target)["id"])
    nodes = analysis.nodes.withColumnRenamed("work_label", "label").orderBy("label")
    if format == "json":
        import json

        return json.dumps({"nodes": _plain(nodes), "links": _plain(analysis.links.orderBy("source", "target"))}, indent=2, ensure_ascii=False)
    cited = analysis.links.join(nodes.withColumnRenamed("id", "target"), "target").orderBy("source", "label") if format == "markdown" else None
    return export.render(nodes, format, cited)


def viewer_data(engine: Engine, target: str = "") -> dict:
    """What a graph viewer draws: nodes with size, links, and whether a force layout is needed."""
    from canopy.functions.scalar import viewer_size

    analysis = engine.load_analysis(engine.resolve(target)["id"])
    nodes = analysis.nodes.select("id", "work_label", "title", "category", viewer_size(F.col("rootness"), F.col("trunkness"), F.col("leafness")).alias("size"))
    links = _plain(analysis.links)
    return {"nodes": _plain(nodes), "links": links, "force": len(links) > 100}
