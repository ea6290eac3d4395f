"""Queries over stored collections, nodes, links and the text of works, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import scalar as S
from canopy.operators import analysis as A
from canopy.operators import search as X
from canopy.session import table

#: Parameters of the queries.
TOP, QUERY, PHRASES = 20, "citation network", 'tree-of-science "field station"'


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return A.current_nodes(table(spark, folder, "nodes"))


def _top(category: str):
    def query(spark, folder):
        top = A.top_by_category(_nodes(spark, folder), category, TOP, ["collection_id"])
        return top.select("collection_id", "place", "id", "score", F.round("normal", 6).alias("normal"))

    return query


def normalize_scores(spark, folder):
    return A.normalized(_nodes(spark, folder)).select("id", *[F.round(s, 6).alias(s) for s in A.SCORES.values()])


def viewer_size(spark, folder):
    sizes = _nodes(spark, folder).withColumns({s: F.coalesce(A.number(s), F.lit(0.0)) for s in A.SCORES.values()})
    return sizes.select("id", S.viewer_size(F.col("rootness"), F.col("trunkness"), F.col("leafness")).alias("size"))


def node_metadata(spark, folder):
    works = table(spark, folder, "works").groupBy(F.col("label").alias("work_label")).agg(F.min_by(F.struct("title", "year", "venue", "doi", "rich"), "work_id").alias("w"))
    return _nodes(spark, folder).join(works, "work_label", "left").select("id", "work_label", "category", "w.title", "w.year", "w.venue", "w.doi", "w.rich")


def analysis_keep(spark, folder):
    nodes, links = _nodes(spark, folder), A.current_links(table(spark, folder, "links"))
    kept = A.Analysis(nodes, links.withColumnsRenamed({"source_id": "source", "target_id": "target"})).keep(nodes.where("category in ('root', 'trunk')"))
    return kept.links.select("collection_id", "source", "target", "weight")


def upsert_links(spark, folder):
    return A.current_links(table(spark, folder, "links"))


def upsert_nodes(spark, folder):
    nodes = table(spark, folder, "nodes").where("removed_at is null")
    last = nodes.groupBy("collection_id", "work_label").agg(F.max_by(F.struct("id", "category"), F.struct("loaded_at", "id")).alias("n"), F.count(F.lit(1)).alias("deliveries"))
    return last.select("collection_id", "work_label", "n.id", "n.category", "deliveries")


def work_count(spark, folder):
    counts = _nodes(spark, folder).groupBy(F.col("collection_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, folder, "collections").join(counts, "id", "left").select("id", F.col("work_count").alias("stored"), F.coalesce("n", F.lit(0)).alias("counted"))


def links_with_ends(spark, folder):
    """Links of which both ends are current nodes of the collection, with the works' labels."""
    nodes = _nodes(spark, folder).select("collection_id", "id", "work_label")
    end = lambda c, l: nodes.select("collection_id", F.col("id").alias(c), F.col("work_label").alias(l))
    return A.current_links(table(spark, folder, "links")).join(end("source_id", "source_label"), ["collection_id", "source_id"]).join(end("target_id", "target_label"), ["collection_id", "target_id"]).select("collection_id", "source_label", "target_label", "weight")


def list_collections(spark, folder):
    return table(spark, folder, "collections").select("id", S.normalize_query(F.col("query")).alias("query"), "name", "work_count", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(10_000)


def latest_collection(spark, folder):
    """The latest collection of each query and limit."""
    c = table(spark, folder, "collections")
    return c.groupBy(S.normalize_query(F.col("query")).alias("query"), "result_limit").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), F.count(F.lit(1)).alias("n"))


def resolve_collection(spark, folder):
    """Each stored id and name as a target: the id of the collection it resolves to."""
    c = table(spark, folder, "collections").select("id", "name", "created_at")
    targets = c.select(F.col("id").alias("target")).union(c.where("name is not null").select("name")).distinct()
    by_id, by_name = c.select(F.col("id").alias("target"), F.col("id").alias("i")), c.where("name is not null").groupBy(F.col("name").alias("target")).agg(F.max_by("id", F.struct("created_at", "id")).alias("j"))
    return targets.join(by_id, "target", "left").join(by_name, "target", "left").select("target", F.coalesce("i", "j").alias("id"))


def _asked(spark, folder):
    """Nodes (of the works table) and names to find: labels, identifiers and DOIs as typed, and unknown ones."""
    works = table(spark, folder, "works").where("size(ids) > 0")
    nodes = works.select(F.col("work_id").alias("node"), S.work_key(F.col("ids")).alias("id"), "label", "authors", "year", "doi", "ids")
    some = works.select("work_id", F.concat(F.lit(" HTTPS://DOI.ORG/"), "doi").alias("target")).union(works.select("work_id", F.upper(F.element_at("ids", -1)))).union(works.select("work_id", F.concat(F.lit("nowhere:"), F.col("work_id").cast("string"))))
    return nodes, some.where("target is not null").select(F.col("work_id").alias("pos"), "target")


def get_works(spark, folder):
    nodes, targets = _asked(spark, folder)
    return A.find_works(nodes, targets)[0]


def not_found(spark, folder):
    nodes, targets = _asked(spark, folder)
    return A.find_works(nodes, targets)[1]


def preset_tos(spark, folder):
    """Roots, then trunk, then leaves of each collection, each work once in its first list."""
    nodes = _nodes(spark, folder)
    lists = [A.top_by_category(nodes, c, TOP, ["collection_id"]).select("collection_id", "work_label", F.lit(i).alias("list"), "place") for i, c in enumerate(A.SCORES)]
    both = lists[0].union(lists[1]).union(lists[2])
    return both.groupBy("collection_id", "work_label").agg(F.min(F.struct("list", "place")).alias("f")).select("collection_id", "work_label", "f.list", "f.place")


def _texts(spark, folder):
    return table(spark, folder, "works").select("work_id", "title", "abstract")


def _documents(spark, folder):
    """Works with the four fields that the reference searches."""
    return table(spark, folder, "works").select("work_id", *X.FIELDS)


def bm25_search(spark, folder):
    return X.bm25(_texts(spark, folder), "work_id", QUERY, stemmed=False).select("work_id", F.round("score", 6).alias("score"))


def bm25_search_all_fields(spark, folder):
    return X.bm25(_documents(spark, folder), "work_id", QUERY, stemmed=False).select("work_id", F.round("score", 6).alias("score"))


def search_phrases(spark, folder):
    return X.bm25(_texts(spark, folder), "work_id", PHRASES, stemmed=False).select("work_id", F.round("score", 6).alias("score"))


def search_phrases_all_fields(spark, folder):
    return X.bm25(_documents(spark, folder), "work_id", PHRASES, stemmed=False).select("work_id", F.round("score", 6).alias("score"))


def bm25_search_stemmed(spark, folder):
    return X.bm25(table(spark, folder, "works"), "work_id", "citations networks", stemmed=True).select("work_id", F.round("score", 6).alias("score"))


def _search_latest(spark, folder, fields):
    """The best matches that are nodes of the latest collection; ranked over all works."""
    works = table(spark, folder, "works").groupBy("label").agg(F.min_by(F.struct(*fields), "work_id").alias("w")).select("label", "w.*")
    latest = table(spark, folder, "collections").orderBy(F.desc("created_at"), F.desc("id")).limit(1).select(F.col("id").alias("collection_id"))
    nodes = _nodes(spark, folder).join(F.broadcast(latest), "collection_id", "left_semi")  # one row
    return X.search_collection(works, nodes, "citation", 10, stemmed=False).select("label", F.round("score", 6).alias("score"))


def search_collection(spark, folder):
    return _search_latest(spark, folder, ["title", "abstract"])


def search_collection_all_fields(spark, folder):
    return _search_latest(spark, folder, X.FIELDS)


def _frequencies(works):
    index = X.postings(works, "work_id", stemmed=False)
    return index.groupBy("term").agg(F.count_distinct("work_id").alias("works"), F.count(F.lit(1)).alias("uses"))


def words_index(spark, folder):
    """Document frequency of every word of titles."""
    return _frequencies(table(spark, folder, "works").select("work_id", "title"))


def words_index_all_fields(spark, folder):
    """Document frequency of every word of the four fields."""
    return _frequencies(_documents(spark, folder))


_CUR = "with cur as (select * from nodes qualify row_number() over (partition by id order by loaded_at desc) = 1), n as (select * from cur where removed_at is null)"
_NUM = lambda c: f"(case when {c} > 0 and not isnan({c}) then {c} end)"
_NORM = lambda s, m: f"round(case when {s} is null or {m} is null or {s} <= 0 then 0.0 when {s} >= {m} then 1.0 else ln(1 + {s}) / ln(1 + {m}) end, 6)"
_LINKS = ", l as (select collection_id, source_id, target_id, coalesce(nullif(arg_max_null(weight, (loaded_at, link_seq)), 0), 1.0) as weight from links where trim(source_id) <> '' and trim(target_id) <> '' group by all)"
_BLANK = r"'[\s\p{Z}]+'"
_NQ = rf"regexp_replace(lower(regexp_replace(query, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), {_BLANK}, ' ', 'g')"


def _top_sql(score: str) -> str:
    return f"""{_CUR}, s as (select collection_id, id, {_NUM(score)} as score, row_number() over (partition by collection_id order by {_NUM(score)} desc, work_label, id) as place from n where {_NUM(score)} is not null),
t as (select * from s where place <= {TOP})
select collection_id, place, id, score, {_NORM("score", "max(score) over (partition by collection_id)")} as normal from t"""


_TWO = "select work_id, 'title' col, title txt from {works} union all select work_id, 'abstract', abstract from {works}"
#: Lists are searched as their JSON text.
_FOUR = _TWO + " union all select work_id, 'keywords', cast(to_json(keywords) as varchar) from {works} union all select work_id, 'authors', cast(to_json(authors) as varchar) from {works}"


def _bm25_sql(phrases: list[list[str]], works: str = "works", fields: str = _TWO) -> str:
    """BM25 over the given fields for phrases of plain words."""
    found = []
    for i, p in enumerate(phrases):
        joins = " ".join(f"join tok t{k} on t{k}.work_id = t0.work_id and t{k}.col = t0.col and t{k}.pos = t0.pos + {k} and t{k}.term = '{t}'" for k, t in enumerate(p) if k)
        found.append(f"select t0.work_id, {i} as phrase, count(*) as f from tok t0 {joins} where t0.term = '{p[0]}' group by 1")
    return rf"""
with txt as ({fields.format(works=works)}),
arr as (select work_id, col, regexp_extract_all(lower(txt), '[\p{{L}}\p{{N}}]+') a from txt where txt is not null),
tok as (select work_id, col, unnest(a) term, generate_subscripts(a, 1) pos from arr),
size as (select work_id, count(*) d from tok group by 1), shape as (select (select count(*) from {works}) docs, (select count(*) from tok) terms),
hits as ({" union all ".join(found)}), df as (select phrase, count(*) n from hits group by 1),
part as (select hits.work_id, f, d, greatest(case when ln((docs - n + 0.5) / (n + 0.5)) > 0 then ln((docs - n + 0.5) / (n + 0.5)) else 1e-6 end, 1e-6) idf, terms / docs avgdl
  from hits join df using (phrase) join size using (work_id), shape)
select work_id, round(-sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / avgdl))), 6) as score from part group by 1 having count(*) = {len(phrases)}"""


def _collection_sql(columns: str, fields: str) -> str:
    ranked = _bm25_sql([["citation"]], f"(select label as work_id, {columns} from works qualify row_number() over (partition by label order by works.work_id) = 1)", fields)
    return (
        ranked.replace("select work_id, round(", "select work_id as label, round(")
        + """ and work_id in (select work_label from (select * from nodes qualify row_number() over (partition by id order by loaded_at desc) = 1) where removed_at is null
  and collection_id = (select id from collections order by created_at desc, id desc limit 1)) order by score, label limit 10"""
    )


_ASKED = r"""
with w as (select * from works where len(ids) > 0),
ask as (select work_id pos, trim(t) target from (select work_id, ' HTTPS://DOI.ORG/' || doi t from w union all select work_id, upper(ids[-1]) from w union all select work_id, 'nowhere:' || work_id from w) where trim(t) <> ''),
cut as (select pos, target, regexp_replace(target, '(?i)^(https?://(dx\.)?doi\.org/|doi:)', '') d, case when contains(target, ':') then regexp_replace(target, '^[^:]*:', '') end b,
  nullif(regexp_replace(regexp_replace(target, '^openalex:', ''), '^https://openalex\.org/', ''), '') o from ask),
names as (select distinct pos, target, lower(unnest(['r' || target, 'd' || d, 'x' || target, 'x' || b, 'o' || o])) alias from cut),
own as (select work_id node, list_min(ids) id, label, lower(replace(split_part(authors[1], ' ', 1), ',', '') || cast(year as varchar)) sid, doi, ids from w),
each as (select node, unnest(ids) i from own),
alias as (select node, lower('r' || id) alias from own union select node, lower('r' || label) from own union select node, 'r' || sid from own
  union select node, lower('d' || regexp_replace(trim(nullif(doi, '')), '(?i)^(https?://(dx\.)?doi\.org/|doi:)', '')) from own
  union select node, lower('x' || i) from each union select node, lower('x' || regexp_replace(i, '^[^:]*:', '')) from each where contains(i, ':')
  union select node, lower('o' || nullif(regexp_replace(regexp_replace(i, '^openalex:', ''), '^https://openalex\.org/', ''), '')) from each),
hits as (select pos, target, min(node) node from names join alias using (alias) group by all)
"""

QUERIES = {f"category_top_{k}s" if k != "leaf" else "category_top_leaves": _top(k) for k in A.SCORES} | {
    f.__name__: f
    for f in (normalize_scores, viewer_size, node_metadata, analysis_keep, upsert_links, upsert_nodes, work_count, links_with_ends, list_collections, latest_collection, resolve_collection, get_works, not_found, preset_tos, bm25_search, bm25_search_all_fields, search_phrases, search_phrases_all_fields, bm25_search_stemmed, search_collection, search_collection_all_fields, words_index, words_index_all_fields)
}
ORACLE = {
    "category_top_roots": _top_sql("rootness"),
    "category_top_trunks": _top_sql("trunkness"),
    "category_top_leaves": _top_sql("leafness"),
    "normalize_scores": f"{_CUR} select id, " + ", ".join(f"{_NORM(_NUM(s), f'max({_NUM(s)}) over (partition by collection_id)')} as {s}" for s in A.SCORES.values()) + " from n",
    "viewer_size": f"{_CUR} select id, greatest({', '.join(f'coalesce({_NUM(s)}, 0)' for s in A.SCORES.values())}) as size from n",
    "node_metadata": f"{_CUR}, w as (select * from works qualify row_number() over (partition by label order by work_id) = 1) select n.id, n.work_label, n.category, w.title, w.year, w.venue, w.doi, w.rich from n left join w on w.label = n.work_label",
    "analysis_keep": f"{_CUR}{_LINKS}, k as (select id from n where category in ('root', 'trunk')) select collection_id, source_id as source, target_id as target, weight from l where source_id in (select id from k) and target_id in (select id from k)",
    "upsert_links": f"{_CUR}{_LINKS} select collection_id, source_id, target_id, weight from l",
    "upsert_nodes": "select collection_id, work_label, arg_max(id, (loaded_at, id)) as id, arg_max(category, (loaded_at, id)) as category, count(*) as deliveries from nodes where removed_at is null group by all",
    "work_count": f"{_CUR} select id, work_count as stored, (select count(*) from n where n.collection_id = collections.id) as counted from collections",
    "links_with_ends": f"{_CUR}{_LINKS} select l.collection_id, a.work_label as source_label, b.work_label as target_label, weight from l join n a on a.collection_id = l.collection_id and a.id = source_id join n b on b.collection_id = l.collection_id and b.id = target_id",
    "list_collections": f"select id, {_NQ} as query, name, work_count, created_at from collections order by created_at desc, id desc limit 10000",
    "latest_collection": f"select {_NQ} as query, result_limit, arg_max(id, (created_at, id)) as id, count(*) as n from collections group by 1, 2",
    "resolve_collection": "with t as (select id target from collections union select name from collections where name is not null) select target, coalesce((select id from collections where id = target), (select arg_max(id, (created_at, id)) from collections where name = target)) as id from t",
    "get_works": _ASKED + "select node, min(pos) as pos from hits group by 1",
    "not_found": _ASKED + "select distinct pos, target from names where (pos, target) not in (select (pos, target) from hits)",
    "preset_tos": f"""{_CUR}, s as (""" + " union all ".join(f"select collection_id, work_label, {i} as list, row_number() over (partition by collection_id order by {_NUM(c)} desc, work_label, id) as place from n where {_NUM(c)} is not null" for i, c in enumerate(A.SCORES.values())) + f""")
select collection_id, work_label, min((list, place))[1] as list, min((list, place))[2] as place from s where place <= {TOP} group by 1, 2""",
    "bm25_search": _bm25_sql([["citation"], ["network"]]),
    "bm25_search_all_fields": _bm25_sql([["citation"], ["network"]], fields=_FOUR),
    "search_phrases_all_fields": _bm25_sql([["tree", "of", "science"], ["field"], ["station"]], fields=_FOUR),
    "search_phrases": _bm25_sql([["tree", "of", "science"], ["field"], ["station"]]),
    "search_collection": _collection_sql("title, abstract", _TWO),
    "search_collection_all_fields": _collection_sql(", ".join(X.FIELDS), _FOUR),
    "words_index": r"with t as (select work_id, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}]+')) term from works) select term, count(distinct work_id) as works, count(*) as uses from t group by 1",
    "words_index_all_fields": f"with txt as ({_FOUR.format(works='works')})"
    r", t as (select work_id, unnest(regexp_extract_all(lower(txt), '[\p{L}\p{N}]+')) term from txt) select term, count(distinct work_id) as works, count(*) as uses from t group by 1",
}
