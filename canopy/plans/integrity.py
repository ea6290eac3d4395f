"""Queries of problem 3 over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canopy.operators.integrity import collection_references, report_by_period, table_references
from canopy.session import table


def _references(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table_references(*[table(spark, folder, t) for t in ("links", "nodes", "raw_works", "works")])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _references(spark, folder)[1].select("ref_table", "row_id", "field", "ref_key")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return report_by_period(*_references(spark, folder), "ref_table", "ref_time")


def p3_collections(spark: SparkSession, folder: str) -> DataFrame:
    return collection_references(table(spark, folder, "links"), table(spark, folder, "nodes"))


_FLAGGED = r"""
with r as (
  select 'links' ref_table, link_seq row_id, 'source_id' field, source_id ref_key, source_id k, loaded_at t from links
  union all select 'links', link_seq, 'target_id', target_id, target_id, loaded_at from links
  union all select distinct 'raw_works', rec_id, 'referenced_works', u, nullif(regexp_extract(u, '[Ww]([0-9]+)\s*$', 1), ''), fetched_at
  from (select rec_id, fetched_at, unnest(referenced_works) u from raw_works)
), live as (
  select 'links' ref_table, id k, min(loaded_at) f from nodes where removed_at is null group by all
  union all select 'raw_works', nullif(regexp_extract(label, '[Ww]([0-9]+)\s*$', 1), ''), min(loaded_at) from works where removed_at is null group by all
), flagged as (
  select r.*, coalesce(live.f <= r.t, false) = false as is_orphan from r left join live on r.ref_table = live.ref_table and r.k = live.k
  where trim(ref_key) <> ''
)
"""

_COLLECTIONS = """
with l as (select link_seq, collection_id, target_id, nullif(trim(collection_id), '') c, nullif(trim(target_id), '') t, loaded_at from links),
n as (select collection_id c, id t, loaded_at from nodes where removed_at is null),
held as (
  select link_seq from l join n on l.c = n.c and l.target_id = n.t and n.loaded_at <= l.loaded_at
  union select link_seq from l join (select c, min(loaded_at) f from n group by 1) n on l.c = n.c and l.t is null and f <= l.loaded_at
  union select link_seq from l join (select t, min(loaded_at) f from n group by 1) n on l.target_id = n.t and l.c is null and f <= l.loaded_at)
select link_seq, collection_id, target_id from l where (c is not null or t is not null) and link_seq not in (select link_seq from held)
"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p3_collections": p3_collections}
ORACLE = {
    "p3_found": _FLAGGED + "select ref_table, row_id, field, ref_key from flagged where is_orphan",
    "p3_report": _FLAGGED + "select ref_table, strftime(t, '%Y-%m') as month, count(*) as refs, cast(sum(is_orphan::int) as bigint) as orphans from flagged group by all",
    "p3_collections": _COLLECTIONS,
}
