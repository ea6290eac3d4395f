"""Queries of scalar functions, projections and merging over works rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import scalar as S
from canopy.operators import dedup
from canopy.session import ship, table


def _works(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    works = table(spark, folder, "works")
    return works.select("work_id", *columns) if columns else works


def extract_doi(spark, folder):
    doi = F.col("doi")
    return _works(spark, folder, "doi").select("work_id", S.extract_doi(F.concat(F.lit("https://doi.org/"), doi)).alias("from_url"), S.extract_doi(F.concat(F.lit(" DOI:"), doi, F.lit(" "))).alias("from_scheme"), S.extract_doi(doi).alias("plain"))


def invert_name(spark, folder):
    each = _works(spark, folder, "authors").select("work_id", F.posexplode("authors").alias("pos", "name"))
    return each.select("work_id", "pos", S.invert_name(F.col("name")).alias("inverted"))


def _index(text):
    """The inverted index of a text: its words with their places."""
    words = S.fields(text)
    return F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.transform(words, lambda x, i: F.when(x == w, i).otherwise(F.lit(-1))), lambda p: p >= 0))))


def invert_abstract(spark, folder):
    return _works(spark, folder, "abstract").select("work_id", S.invert_abstract(_index(F.col("abstract"))).alias("abstract"))


def page_range(spark, folder):
    pages = F.split("page", "-")
    return _works(spark, folder, "page").select("work_id", S.page_range(F.get(pages, F.lit(0)), F.get(pages, F.lit(1))).alias("pages"))


def _nested(spark, folder):
    """works rows in the nested shape of raw records."""
    source = lambda name, kind: F.struct(name.alias("display_name"), kind.alias("type"), F.col("publisher").alias("host_organization_name"))
    primary = F.when(F.col("venue").isNotNull(), source(F.col("venue"), F.col("venue_type")))
    other = source(F.col("publisher"), F.when(F.col("volume").isNotNull(), F.lit("journal")).otherwise(F.lit("repository")))
    place = F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.struct(F.array(F.struct(F.when(a.contains(","), F.col("institution")).otherwise(F.lit("")).alias("display_name"))).alias("institutions")))
    return _works(spark, folder).select("work_id", F.struct(primary.alias("source")).alias("primary_location"), F.array(F.struct(primary.alias("source")), F.struct(other.alias("source"))).alias("locations"), place.alias("authorships"))


def venue_source(spark, folder):
    source = S.venue_source(F.col("primary_location"), F.col("locations"))
    return _nested(spark, folder).select("work_id", source["display_name"].alias("venue"), S.non_empty(source["type"]).alias("venue_type"))


def first_institution(spark, folder):
    return _nested(spark, folder).select("work_id", S.first_institution(F.col("authorships")).alias("institution"))


def work_identity(spark, folder):
    ids = F.col("ids")
    return _works(spark, folder, "ids").select("work_id", S.work_key(ids).alias("work_key"), S.id_of(ids, "doi").alias("doi"), S.id_of(ids, "openalex").alias("catalogue_id"))


def simple_id(spark, folder):
    return _works(spark, folder, "authors", "year").select("work_id", S.simple_id(F.col("authors"), F.col("year")).alias("simple_id"))


def simple_label(spark, folder):
    columns = ["authors", "year", "venue", "volume", "page", "doi"]
    return _works(spark, folder, *columns).select("work_id", S.simple_label(*map(F.col, columns)).alias("simple_label"))


def add_simple_id(spark, folder):
    return _works(spark, folder, "ids", "authors", "year").select("work_id", F.array_join(S.add_simple_id(F.col("ids"), F.col("authors"), F.col("year")), "|").alias("ids"))


def _wanted(spark, folder):
    """The identifiers of works cited ten times or more."""
    return _works(spark, folder, "ids", "times_cited").where("times_cited >= 10").select(F.explode("ids").alias("id")).where("id <> ''")


def keep_references(spark, folder):
    return dedup.references_by_id(_works(spark, folder, "ids", "label"), _wanted(spark, folder), ["work_id"]).select("work_id", "label")


def purge_references(spark, folder):
    return dedup.references_by_id(_works(spark, folder, "ids", "label"), _wanted(spark, folder), ["work_id"], keep=False).select("work_id", "label")


def citation_key(spark, folder):
    ship(spark)
    columns = ["authors", "year", "doi", "ids", "label"]
    return _works(spark, folder, *columns).select("work_id", S.citation_key(*map(F.col, columns)).alias("cite_key"))


def bib_entry_type(spark, folder):
    return _works(spark, folder, "type", "venue", "venue_type").select("work_id", S.bib_entry_type(F.col("type"), F.col("venue"), F.col("venue_type")).alias("entry_type"), S.citable_venue(F.col("venue"), F.col("venue_type")).alias("citable_venue"))


def latex_sanitize(spark, folder):
    text = F.concat_ws(" & ", F.coalesce("title", F.lit("")), F.lit(r"100% of_it #1 \% \\%"))
    return _works(spark, folder, "title").select("work_id", S.sanitize_latex(text).alias("latex"))


def permalink(spark, folder):
    return _works(spark, folder, "permalink", "doi").select("work_id", S.permalink(F.col("permalink"), F.col("doi")).alias("link"))


def filename_slug(spark, folder):
    return _works(spark, folder, "label", "title").select("work_id", S.filename(F.col("work_id").cast("string"), F.col("title"), F.col("label")).alias("filename"))


def query_fingerprint(spark, folder):
    c = table(spark, folder, "collections")
    return c.select("id", S.normalize_query(F.col("query")).alias("normal"), S.query_fingerprint(F.col("query"), F.col("result_limit")).alias("fingerprint"), S.display_query(F.col("query")).alias("shown"))


def set_functions(spark, folder):
    """Set algebra on list columns: keywords against the set {tree of science, open archive}."""
    k, other = F.coalesce("keywords", F.array().cast("array<string>")), F.array(F.lit("tree of science"), F.lit("open archive"))
    return _works(spark, folder, "keywords").select(
        "work_id", F.array_join(F.array_sort(F.array_union(k, other)), "|").alias("all_of"), F.array_join(F.array_sort(F.array_intersect(k, other)), "|").alias("common"), F.array_join(F.array_sort(F.array_except(k, other)), "|").alias("rest"), F.array_contains(k, "open archive").alias("has")
    )


def dedup_components(spark, folder):
    return dedup.id_components(_works(spark, folder, "ids"), "work_id")


def dedup_merge(spark, folder):
    merged, _ = dedup.deduplicate(_works(spark, folder), "work_id")
    text = ["label", "title", "venue", "type", "venue_type", "publisher", "institution", "volume", "issue", "page", "doi", "permalink", "abstract"]
    return merged.select("component", F.array_join("ids", "|").alias("ids"), F.array_join("authors", "|").alias("authors"), F.array_join("keywords", "|").alias("keywords"), *text, "year", "times_cited", "rich")


def dedup_first_occurrence(spark, folder):
    """Works in order of first occurrence: the component, its first row and its rows."""
    return dedup.id_components(_works(spark, folder, "ids"), "work_id").groupBy("component").agg(F.min("work_id").alias("pos"), F.count(F.lit(1)).alias("n"))


def enrich_references(spark, folder):
    """Stubs of works replaced by the first rich row with their identifier; misses are dropped."""
    works = _works(spark, folder, "label", "ids", "title", "rich")
    stubs = dedup.one_per_key(works.where("not rich").select("label", "ids", "title", "rich"), "label")
    best = works.where("rich and size(ids) > 0").groupBy(S.id_of(F.col("ids"), "openalex").alias("k")).agg(F.min(F.struct("work_id", "label", "ids", "title", "rich")).alias("w"))
    out = dedup.enrich(stubs.select("label", "ids", F.lit(None).cast("string").alias("title"), "rich"), best.where("k is not null").select("w.label", "w.ids", "w.title", "w.rich"))
    return out.select("label", "title", "rich")


def upsert_works(spark, folder):
    """Rows of each label merged in order of loading: the latest known value wins, rich is any."""
    works = _works(spark, folder)
    order = lambda c: F.when(F.col(c).isNotNull(), F.struct("loaded_at", "work_id"))
    last = lambda c: F.max_by(F.col(c), order(c)).alias(c)
    return works.groupBy("label").agg(last("title"), last("year"), last("venue"), last("doi"), last("times_cited"), F.bool_or(F.coalesce("rich", F.lit(False))).alias("rich"), F.count(F.lit(1)).alias("n"))


def top_cited(spark, folder):
    return _works(spark, folder, "label", "times_cited").select("work_id", "label", F.coalesce("times_cited", F.lit(0)).alias("cited")).orderBy(F.desc("cited"), "work_id").limit(50)


_D = r"(?i)^(https?://(dx\.)?doi\.org/|doi:)"
_SIMPLE = "lower(replace(split_part(authors[1], ' ', 1), ',', '') || cast(year as varchar))"
_WANTED = "with wanted as (select distinct i from (select unnest(ids) i from works where times_cited >= 10) where i <> ''), hit as (select distinct work_id from (select work_id, unnest(ids) i from works) where i in (select i from wanted)) "
_FIRST = lambda c: f"arg_min({c}, (case when coalesce(rich, false) then 0 else 1 end, work_id)) filter ({c} is not null) as {c}"
_COMP = """
with recursive tok as (select distinct work_id, i from (select work_id, unnest(ids) i from works) where i is not null),
edge as (select distinct a, b from (select work_id a, min(work_id) over (partition by i) b from tok) where a <> b),
both_ways as (select a, b from edge union select b, a from edge),
reach as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
comp as (select t.work_id, least(t.work_id, min(r.b)) as component from (select distinct work_id from tok) t left join reach r on r.a = t.work_id group by 1)
"""

QUERIES = {
    f.__name__: f
    for f in (extract_doi, invert_name, invert_abstract, page_range, venue_source, first_institution, work_identity, simple_id, simple_label, add_simple_id, keep_references, purge_references, citation_key, bib_entry_type, latex_sanitize, permalink, filename_slug, query_fingerprint, set_functions, dedup_components, dedup_merge, dedup_first_occurrence, enrich_references, upsert_works, top_cited)
}
ORACLE = {
    "extract_doi": f"select work_id, regexp_replace(trim('https://doi.org/' || doi), '{_D}', '') as from_url, regexp_replace(trim(' DOI:' || doi || ' '), '{_D}', '') as from_scheme, regexp_replace(trim(doi), '{_D}', '') as plain from works",
    "invert_name": r"""
with n as (select work_id, cast(generate_subscripts(authors, 1) - 1 as int) as pos, unnest(authors) as raw from works),
t as (select work_id, pos, regexp_replace(raw, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') as s from n),
w as (select *, list_filter(regexp_split_to_array(s, '[\s\p{Z}]+'), lambda x: x <> '') as p from t)
select work_id, pos, case when contains(s, ',') or len(p) < 2 then s else p[-1] || ', ' || array_to_string(p[:-2], ' ') end as inverted from w""",
    "invert_abstract": r"select work_id, coalesce(trim(regexp_replace(abstract, '[\s\p{Z}]+', ' ', 'g')), '') as abstract from works",
    "page_range": "select work_id, case when coalesce(split_part(page, '-', 1), '') = '' then null when contains(page, '-') and split_part(page, '-', 2) not in ('', split_part(page, '-', 1)) then split_part(page, '-', 1) || '-' || split_part(page, '-', 2) else split_part(page, '-', 1) end as pages from works",
    "venue_source": """
select work_id, case when venue is not null and coalesce(venue_type, '') <> 'repository' then venue when volume is not null then publisher else venue end as venue,
  nullif(case when venue is not null and coalesce(venue_type, '') <> 'repository' then venue_type when volume is not null then 'journal' else case when venue is not null then venue_type end end, '') as venue_type from works""",
    "first_institution": "select work_id, case when len(list_filter(authors, lambda a: contains(a, ','))) > 0 then nullif(institution, '') end as institution from works",
    "work_identity": "select work_id, list_min(ids) as work_key, regexp_replace(list_filter(list_sort(ids), lambda x: starts_with(x, 'doi:'))[1], '^doi:', '') as doi, regexp_replace(list_filter(list_sort(ids), lambda x: starts_with(x, 'openalex:'))[1], '^openalex:', '') as catalogue_id from works",
    "simple_id": f"select work_id, {_SIMPLE} as simple_id from works",
    "simple_label": "select work_id, nullif(concat_ws(', ', replace(authors[1], ',', ''), cast(year as varchar), venue, 'V' || volume, 'P' || page, 'DOI ' || doi), '') as simple_label from works",
    "add_simple_id": f"select work_id, array_to_string(list_sort(list_distinct(list_concat(list_filter(coalesce(ids, []), lambda x: x is not null), list_filter(['simple:' || nullif({_SIMPLE}, '')], lambda x: x is not null)))), '|') as ids from works",
    "keep_references": _WANTED + "select work_id, label from works where work_id in (select work_id from hit)",
    "purge_references": _WANTED + "select work_id, label from works where work_id not in (select work_id from hit)",
    "citation_key": rf"""
select work_id, coalesce(nullif(lower(regexp_replace(regexp_replace(strip_accents(
  coalesce(nullif({_SIMPLE}, ''), 'doi_' || regexp_replace(trim(nullif(doi, '')), '{_D}', ''),
    nullif(regexp_replace(regexp_replace(list_filter(list_sort(ids), lambda x: starts_with(x, 'openalex:'))[1], '^openalex:', ''), '^https://openalex\.org/', ''), ''),
    nullif(list_min(ids), ''), nullif(label, ''), 'article')), '[^a-zA-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g')), ''), 'article') as cite_key from works""",
    "bib_entry_type": """
select work_id, case when type = 'conference-paper' or venue_type = 'conference' then 'inproceedings' when type = 'book' then 'book' when type = 'report' then 'techreport'
  when type = 'book-chapter' then 'incollection' when type = 'dissertation' then 'phdthesis' when venue_type = 'repository' then 'misc'
  when coalesce(venue, '') <> '' and coalesce(venue_type, '') not in ('repository', 'ebook platform') then 'article' else 'misc' end as entry_type,
  case when coalesce(venue_type, '') in ('repository', 'ebook platform') then '' else coalesce(venue, '') end as citable_venue from works""",
    "latex_sanitize": r"select work_id, regexp_replace(coalesce(title, ''), '([%&_#])', '\\\1', 'g') || ' \& ' || '100\% of\_it \#1 \% \\\%' as latex from works",
    "permalink": "select work_id, coalesce(nullif(permalink, ''), 'https://doi.org/' || nullif(doi, '')) as link from works",
    "filename_slug": r"""
select work_id, coalesce(nullif(regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(nullif(title, ''), nullif(label, ''), 'article')), '[^a-z0-9\s_-]', '', 'g'), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), '-+$', ''), ''), 'article')
  || '-' || left(sha256(cast(work_id as varchar)), 8) || '.md' as filename from works""",
    "query_fingerprint": r"""
with n as (select *, regexp_replace(lower(trim(regexp_replace(query, '[\s\p{Z}]+', ' ', 'g'))), '\s+', ' ', 'g') as normal from collections)
select id, normal, sha256('{"version":3,"limit":' || result_limit || ',"query":"' || replace(replace(replace(replace(normal, '"', '\"'), '&', '&'), '<', '<'), '>', '>') || '"}') as fingerprint,
  case when octet_length(encode(query)) > 40 then left(query, 37) || '...' else query end as shown from n""",
    "set_functions": """
with w as (select work_id, coalesce(keywords, []) as k, ['tree of science', 'open archive'] as o from works)
select work_id, array_to_string(list_sort(list_distinct(list_concat(k, o))), '|') as all_of, array_to_string(list_sort(list_distinct(list_intersect(k, o))), '|') as common,
  array_to_string(list_sort(list_distinct(list_filter(k, lambda x: not list_contains(['tree of science', 'open archive'], x)))), '|') as rest, list_contains(k, 'open archive') as has from w""",
    "dedup_components": _COMP + "select work_id, component from comp",
    "dedup_first_occurrence": _COMP + "select component, min(work_id) as pos, count(*) as n from comp group by 1",
    "dedup_merge": _COMP + f"""
select component, array_to_string(list_sort(list_distinct(flatten(list(ids)))), '|') as ids,
  array_to_string(arg_min(authors, (-coalesce(len(authors), -1), case when coalesce(rich, false) then 0 else 1 end, work_id)) filter (authors is not null), '|') as authors,
  array_to_string(list_sort(list_distinct(flatten(list(coalesce(keywords, []))))), '|') as keywords, arg_min(label, (-octet_length(encode(label)), label)) as label,
  {", ".join(_FIRST(c) for c in ("title", "venue", "type", "venue_type", "publisher", "institution", "volume", "issue", "page", "doi", "permalink", "abstract", "year", "times_cited"))},
  bool_or(coalesce(rich, false)) as rich
from comp join works using (work_id) group by component""",
    "enrich_references": """
with stub as (select label, arg_min(ids, work_id) ids from works where not rich group by 1),
k as (select label, regexp_replace(list_filter(list_sort(ids), lambda x: starts_with(x, 'openalex:'))[1], '^openalex:', '') as k from stub),
best as (select k, min(work_id) m from (select work_id, regexp_replace(list_filter(list_sort(ids), lambda x: starts_with(x, 'openalex:'))[1], '^openalex:', '') as k from works where rich and len(ids) > 0) where k is not null group by 1)
select coalesce(w.label, k.label) as label, w.title, coalesce(w.rich, false) as rich from k left join best using (k) left join works w on w.work_id = best.m where k.k is null or best.m is not null""",
    "upsert_works": "select label, " + ", ".join(f"arg_max({c}, (loaded_at, work_id)) filter ({c} is not null) as {c}" for c in ("title", "year", "venue", "doi", "times_cited")) + ", bool_or(coalesce(rich, false)) as rich, count(*) as n from works group by label",
    "top_cited": "select work_id, label, coalesce(times_cited, 0) as cited from works order by cited desc, work_id limit 50",
}
