"""Queries of the llm problems over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canopy.llm import forms, mixing, names, reduce, survivor, tokens, topn, truncation
from canopy.session import table

#: Parameter of problem 6: places per collection and score.
TOP = 10


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    scores = ["rootness", "trunkness", "leafness"]
    latest = topn.latest_rows(table(spark, folder, "nodes"), "id", "loaded_at", ["collection_id", *scores, "removed_at"])
    live = latest.where("removed_at is null").withColumnRenamed("id", "node_id")
    return topn.top_n_per_group(live, "collection_id", "node_id", scores, TOP)


P6_SQL = """
with latest as (select * from nodes qualify row_number() over (partition by id order by loaded_at desc) = 1),
s as (
  select collection_id, 'rootness' as score_name, rootness as v, id from latest where removed_at is null
  union all select collection_id, 'trunkness', trunkness, id from latest where removed_at is null
  union all select collection_id, 'leafness', leafness, id from latest where removed_at is null)
select collection_id, score_name, row_number() over (partition by collection_id, score_name order by v desc, id) as place, id as node_id
from s where v > 0 and not isnan(v) qualify place <= 10
"""


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    works = table(spark, folder, "works").select("work_id", "label", "ids")
    return reduce.group_works(works, table(spark, folder, "match_pairs"))


P5_SQL = r"""
with recursive tok as (
  select work_id, 'L' || label as t from works where trim(label) <> ''
  union select work_id, 'I' || lower(trim(i)) from (select work_id, unnest(ids) i from works) where i is not null and not regexp_matches(trim(i), '^([^:]*:)?\s*$')
), lab as (select label, min(work_id) m from works group by 1),
edge as (
  select distinct a, b from (
    select work_id a, min(work_id) over (partition by t) b from tok
    union all select x.m, y.m from match_pairs join lab x on x.label = label_a join lab y on y.label = label_b) where a <> b
), both_ways as (select a, b from edge union select b, a from edge),
reach as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a)
select a as work_id, least(a, min(b)) as group_id from reach group by a
"""


def _works(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "works")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.name_pairs(names.link_names(table(spark, folder, "name_forms")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return forms.look_alike_works(_works(spark, folder).select("work_id", "title", "authors"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivor.suppliers(_works(spark, folder), p5_found(spark, folder))


def p4_merged(spark: SparkSession, folder: str) -> DataFrame:
    return survivor.merged_records(_works(spark, folder), p5_found(spark, folder))


def p4_current(spark: SparkSession, folder: str) -> DataFrame:
    """(group_id, field, value, work_id): the values that currency decides, before they are merged."""
    rows = _works(spark, folder).select("work_id", "updated_at", *survivor.CURRENT_FIELDS).join(p5_found(spark, folder), "work_id")
    learned = survivor.closed(survivor.transitions(rows, "group_id", "updated_at", survivor.CURRENT_FIELDS))
    return survivor.current_values(rows, "group_id", "updated_at", survivor.CURRENT_FIELDS, learned)


_CELLS = ", ".join(f"struct_pack(field := '{f}', value := cast({f} as varchar))" for f in survivor.CURRENT_FIELDS)
P4_CURRENT_SQL = (
    P5_SQL.rsplit("\nselect a as work_id", 1)[0]
    + f""",
grp as (select a as work_id, least(a, min(b)) as group_id from reach group by a),
cell as (select work_id, group_id, updated_at t, unnest([{_CELLS}]) c from works join grp using (work_id)),
vals as (select group_id, c.field as field, c.value as value, max(t) as stamp, count(*) as n, min(work_id) work_id from cell where trim(c.value) <> '' group by all),
step as (select field, value as newer, stamp, lag(value) over w as older, lag(stamp) over w as before from vals where stamp is not null window w as (partition by group_id, field order by stamp, value)),
seen as (select field, older, newer, count(*) as n from step where before < stamp group by all),
learned as (select x.field, x.older, x.newer from seen x left join seen y on x.field = y.field and x.older = y.newer and x.newer = y.older where x.n >= {survivor.SEEN} and x.n >= {survivor.MARGIN} * coalesce(y.n, 0)),
chain as (select field, older, newer from learned union select c.field, c.older, l.newer from chain c join learned l on c.field = l.field and c.newer = l.older where c.older <> l.newer),
late as (select distinct a.group_id, a.field, a.value from vals a join vals b on a.group_id = b.group_id and a.field = b.field join chain c on c.field = a.field and c.older = a.value and c.newer = b.value
  where (a.stamp is null or b.stamp is null) and not exists (select 1 from chain d where d.field = c.field and d.older = c.newer and d.newer = c.older)),
ranked as (select v.*, case when v.stamp < max(v.stamp) over (partition by v.group_id, v.field) or l.value is not null then 0 else 1 end as kept from vals v left join late l on l.group_id = v.group_id and l.field = v.field and l.value = v.value)
select group_id, field, value, work_id from ranked qualify row_number() over (partition by group_id, field order by kept desc, (stamp is not null) desc, stamp desc nulls last, n desc, work_id, value desc) = 1"""
)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_texts(table(spark, folder, "documents"), "doc_id", "text")


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.flag_truncated(table(spark, folder, "documents")).where("truncated").select("doc_id")


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_rates(truncation.flag_truncated(table(spark, folder, "documents")))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p4_merged": p4_merged, "p4_current": p4_current, "p5_found": p5_found, "p6_found": p6_found, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_report": p8_report, "p9_found": p9_found, "p9_rates": p9_rates}
ORACLE = {"p4_current": P4_CURRENT_SQL, "p5_found": P5_SQL, "p6_found": P6_SQL}
