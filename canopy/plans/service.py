"""Queries that run through the stored collections and the service, with their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import scalar as S
from canopy.operators import analysis as A
from canopy.operators import dedup
from canopy.plans import catalog, works
from canopy.plans.engine import PRESETS, Engine
from canopy.schema import TABLES, WORK_COLUMNS
from canopy.session import checkpoint_dir, table
from canopy.sources.store import Store

#: Stores that this process has filled, by session and data folder.
_FILLED: dict[tuple[str, str], Store] = {}


def stored(spark: SparkSession, folder: str) -> Engine:
    """The service over a store in the shared checkpoint folder that holds the test tables.

    Of a label's works rows the first delivery is stored, then the last one is upserted;
    nodes and links are the current ones of all collections.
    """
    mark = (spark.sparkContext.applicationId, folder)
    if mark not in _FILLED:
        store = Store(spark, f"{checkpoint_dir(spark)}/stores/{hashlib.md5('|'.join(mark).encode()).hexdigest()}")
        rows = table(spark, folder, "works").where("label is not null")
        pick = lambda best: rows.groupBy("label").agg(best(F.struct(*[c for c in WORK_COLUMNS if c != "label"]), F.col("work_id")).alias("w")).select("label", "w.*")
        store.put("works", pick(F.min_by))
        store.upsert(pick(F.max_by))
        c = table(spark, folder, "collections")
        columns = {"query_hash": F.hex("query_hash"), "query": S.normalize_query(F.col("query"))}
        store.put("collections", c.withColumns(columns).select(*[F.col(x.split()[0]).cast(x.split()[1] if x.split()[1] != "long" else "bigint") for x in TABLES["collections"].split(", ")]))
        store.put("nodes", A.current_nodes(table(spark, folder, "nodes")))
        store.put("links", A.current_links(table(spark, folder, "links")).withColumnsRenamed({"source_id": "source", "target_id": "target"}))
        store.commit()
        _FILLED[mark] = store
    return Engine(spark, _FILLED[mark])


def store_works(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder).store.table("works").select("label", "title", "year", "venue", "publisher", "doi", "times_cited", "abstract", "rich", F.array_join("ids", "|").alias("ids"))


def store_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder).store.table("nodes").select("collection_id", "id", "work_label", "category")


def engine_list(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(spark, folder).list()
    return spark.createDataFrame([(i, r["id"], r["name"], r["work_count"]) for i, r in enumerate(rows, 1)], "place int, id string, name string, work_count long")


def _latest(spark: SparkSession, folder: str) -> tuple[Engine, str]:
    engine = stored(spark, folder)
    return engine, engine.resolve()["id"]


def engine_nodes(spark: SparkSession, folder: str) -> DataFrame:
    engine, id = _latest(spark, folder)
    return engine.load_analysis(id).nodes.select("id", "work_label", "title", "category", *[F.round(s, 6).alias(s) for s in A.SCORES.values()])


def engine_links(spark: SparkSession, folder: str) -> DataFrame:
    engine, id = _latest(spark, folder)
    return engine.load_analysis(id).links.select("source", "target", "weight")


def _preset(preset: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        engine, id = _latest(spark, folder)
        return engine.preset(id, preset).select("work_label", "id", "title")

    return query


def engine_search(spark: SparkSession, folder: str) -> DataFrame:
    """The stored index terms, searched over all works as bm25_search_stemmed searches texts."""
    from canopy.operators.search import bm25_index

    return bm25_index(stored(spark, folder).store.table("terms"), "label", "citations networks").select("label", F.round("score", 6).alias("score"))


def canonical_citations(spark: SparkSession, folder: str) -> DataFrame:
    """The citations of raw_works between groups of works that share an identifier."""
    number = lambda c: F.nullif(F.regexp_extract(c, r"[Ww]([0-9]+)\s*$", 1), F.lit(""))
    raw = table(spark, folder, "raw_works").select("rec_id", number(F.col("id")).alias("src"), F.posexplode("referenced_works").alias("pos", "r"))
    cites = raw.select("src", number(F.col("r")).alias("dst"), (F.col("rec_id") * 100_000 + F.col("pos")).alias("pos")).dropna()
    rows = table(spark, folder, "works")
    groups = dedup.id_components(rows.select("work_id", "ids"), "work_id").join(rows.select("work_id", number(F.col("label")).alias("id")), "work_id")
    return dedup.canonical_citations(cites, groups.where("id is not null").groupBy("id").agg(F.min("component").alias("component")))


def _named(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All works and, as names to find, their labels, keys and simple ids."""
    rows = table(spark, folder, "works")
    nodes = rows.select(F.col("work_id").alias("node"), S.work_key(F.col("ids")).alias("id"), "label", "authors", "year", "doi", "ids")
    names = nodes.select("node", F.col("label").alias("target")).union(nodes.select("node", F.upper("id"))).union(nodes.select("node", S.simple_id(F.col("authors"), F.col("year"))))
    return nodes, names.where("target is not null").select(F.col("node").alias("pos"), "target")


def find_by_names(spark: SparkSession, folder: str) -> DataFrame:
    return A.find_works(*_named(spark, folder))[0]


_STORED = "w as (select label, {} from (select label, arg_min_null(struct_pack({}), work_id) a, arg_max_null(struct_pack({}), work_id) b from works where label is not null group by 1))"
_FIELDS = ["title", "year", "venue", "publisher", "doi", "times_cited", "abstract", "ids"]
_PACK = ", ".join(f"{c} := {c}" for c in [*_FIELDS, "rich"])
_W = _STORED.format(", ".join(f"coalesce(b.{c}, a.{c}) as {c}" for c in _FIELDS) + ", coalesce(a.rich, false) or coalesce(b.rich, false) as rich", _PACK, _PACK)
_L = f"{catalog._CUR}{catalog._LINKS}, {_W}, lc as (select id from collections order by created_at desc, id desc limit 1), s as (select n.*, coalesce(list_min(w.ids), work_label) as key, title, times_cited from n join w on w.label = work_label where collection_id = (select id from lc))"
_OF = {c: catalog._NUM(c) for c in A.SCORES.values()}


def _list_sql(scores: list[str]) -> str:
    lists = " union all ".join(f"select key, {i} as l, row_number() over (order by {_OF[c]} desc, work_label, key) as p from s where {_OF[c]} is not null" for i, c in enumerate(scores))
    return f"{_L}, x as ({lists}) select work_label, key as id, title from s where key in (select key from x where p <= 20)"


_HIT = catalog._ASKED.replace("where len(ids) > 0", "").replace(
    "select work_id, ' HTTPS://DOI.ORG/' || doi t from w union all select work_id, upper(ids[-1]) from w union all select work_id, 'nowhere:' || work_id from w",
    "select work_id, label t from w union all select work_id, upper(list_min(ids)) from w union all select work_id, lower(replace(split_part(authors[1], ' ', 1), ',', '') || cast(year as varchar)) from w",
)

QUERIES = {f.__name__: f for f in (store_works, store_nodes, engine_list, engine_nodes, engine_links, engine_search, canonical_citations, find_by_names)} | {f"engine_preset_{p}": _preset(p) for p in PRESETS}
ORACLE = {
    "store_works": f"with {_W} select label, title, year, venue, publisher, doi, times_cited, abstract, rich, array_to_string(list_filter(ids, lambda x: x is not null), '|') as ids from w",
    "store_nodes": f"{catalog._CUR} select collection_id, id, work_label, category from n",
    "engine_list": "select cast(row_number() over (order by created_at desc, id desc) as int) as place, id, name, work_count from collections order by 1 limit 10000",
    "engine_nodes": f"{_L} select key as id, work_label, title, category, " + ", ".join(f"{catalog._NORM(_OF[c], f'max({_OF[c]}) over ()')} as {c}" for c in _OF) + " from s",
    "engine_links": f"{_L} select a.key as source, b.key as target, weight from l join s a on a.id = source_id join s b on b.id = target_id where l.collection_id = (select id from lc)",
    "engine_preset_tos": _list_sql(list(_OF)),
    "engine_preset_roots": _list_sql(["rootness"]),
    "engine_preset_trunks": _list_sql(["trunkness"]),
    "engine_preset_leaves": _list_sql(["leafness"]),
    "engine_preset_top_cited": f"{_L} select work_label, key as id, title from s order by coalesce(times_cited, 0) desc, work_label limit 20",
    "canonical_citations": works._COMP + r""", can as (select nullif(regexp_extract(label, '[Ww]([0-9]+)\s*$', 1), '') id, min(component) c from comp join works using (work_id) group by 1),
cit as (select nullif(regexp_extract(id, '[Ww]([0-9]+)\s*$', 1), '') src, nullif(regexp_extract(r, '[Ww]([0-9]+)\s*$', 1), '') dst, rec_id * 100000 + p - 1 as pos from (select id, rec_id, unnest(referenced_works) r, generate_subscripts(referenced_works, 1) p from raw_works))
select a.c as src, b.c as dst, min(pos) as pos from cit join can a on a.id = src join can b on b.id = dst group by 1, 2""",
    "find_by_names": _HIT + "select node, min(pos) as pos from hits group by 1",
}
