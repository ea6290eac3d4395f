"""References to records that do not exist (problem 3).

A reference is one composite key held by a row. Its columns may be null in part, so
references are grouped by null mask; the match semantics of the foreign key say which
masks are references at all and on which columns each mask is anti-joined:

* ``simple``: a key with any null column is no reference.
* ``full``: a key with all columns null is no reference; one with some is an orphan.
* ``partial``: a key with all columns null is no reference; any other key needs a target
  that agrees on the columns that are not null.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "full", "partial")


def _absent(column: str) -> Column:
    return F.col(column).isNull() | (F.trim(F.col(column).cast("string")) == "")


def _masked(refs: DataFrame, keys: list[tuple[str, str]], match: str) -> DataFrame:
    """The rows that hold a reference, with __mask: bit i is set where key column i is absent."""
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    mask = reduce(lambda a, b: a + b, [F.when(_absent(r), F.lit(1 << i)).otherwise(F.lit(0)) for i, (r, _) in enumerate(keys)])
    return refs.withColumn("__mask", mask).where("__mask = 0" if match == "simple" else F.col("__mask") < (1 << len(keys)) - 1)


def held_references(refs: DataFrame, keys: list[tuple[str, str]], match: str = "simple") -> DataFrame:
    """The rows of `refs` that hold a reference under the match semantics."""
    return _masked(refs, keys, match).drop("__mask")


def orphan_references(
    refs: DataFrame,
    targets: DataFrame,
    keys: list[tuple[str, str]],
    *,
    match: str = "simple",
    ref_time: str | None = None,
    target_time: str | None = None,
) -> DataFrame:
    """The rows of `refs` whose reference has no valid target, in their own columns (names with
    two leading underscores are reserved).

    keys: pairs (column of refs, column of targets). Null and blank strings are absent.
    ref_time, target_time: a target counts only from its target_time on; a reference or
    target whose time is null then counts as having no time, so it matches nothing.
    The rows of each null mask are anti-joined on the columns that are there. Targets that
    repeat a key are reduced to their earliest time before the join, and repeated reference
    rows stay repeated. An empty targets table makes every reference an orphan; an empty
    refs table gives no rows. Hot keys sit on the reference side only, where adaptive skew
    joins may split them.
    """
    if (ref_time is None) != (target_time is None):
        raise ValueError("ref_time and target_time go together")
    refs = _masked(refs, keys, match)
    parts = []
    for absent in product((False, True), repeat=len(keys)):
        mask = sum(1 << i for i, gone in enumerate(absent) if gone)
        if mask and (match == "simple" or all(absent)):
            continue
        own = refs.where(F.col("__mask") == mask)
        if mask and match == "full":
            parts.append(own)
            continue
        used = [k for k, gone in zip(keys, absent) if not gone]
        on = [f"__t{i}" for i in range(len(used))]
        known = targets.where(reduce(lambda a, b: a & b, [~_absent(t) for _, t in used])).groupBy(*[F.col(t).alias(a) for a, (_, t) in zip(on, used)])
        known = known.agg((F.min(target_time) if target_time else F.lit(1)).alias("__from"))
        same = reduce(lambda a, b: a & b, [F.col(r) == F.col(a) for a, (r, _) in zip(on, used)])
        parts.append(own.join(known, same & (F.col("__from") <= F.col(ref_time)) if ref_time else same, "left_anti"))
    return reduce(DataFrame.unionByName, parts).drop("__mask")


def report_by_period(refs: DataFrame, orphans: DataFrame, table: str, time: str) -> DataFrame:
    """References and orphans per table and month: (ref_table, month, refs, orphans).

    refs: all rows that hold a reference; orphans: those of them without a target. Rows
    with a null time are counted under a null month. Both are counted before they meet.
    """
    both = refs.select(table, time, F.lit(1).alias("r"), F.lit(0).alias("o")).union(orphans.select(table, time, F.lit(0), F.lit(1)))
    return both.groupBy(F.col(table).alias("ref_table"), F.date_format(time, "yyyy-MM").alias("month")).agg(F.sum("r").alias("refs"), F.sum("o").alias("orphans"))


#: Fixed value: a work's key ends in its W number, whatever stands before it.
WORK_NUMBER = r"[Ww]([0-9]+)\s*$"


def link_references(links: DataFrame) -> DataFrame:
    """Each link's two keys as rows (ref_table, row_id, field, ref_key, match_key, ref_time)."""
    pair = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("ref_key")) for c in ("source_id", "target_id")])
    return links.select("link_seq", "loaded_at", F.inline(pair)).select(
        F.lit("links").alias("ref_table"), F.col("link_seq").alias("row_id"), "field", "ref_key", F.col("ref_key").alias("match_key"), F.col("loaded_at").alias("ref_time")
    )


def work_references(raw_works: DataFrame) -> DataFrame:
    """Each distinct referenced work of each record, in the columns of link_references.

    A key without a W number can't match a work: its match_key is the key itself, behind a
    prefix that no work number has. A null or blank key gives none.
    """
    number = F.regexp_extract("ref_key", WORK_NUMBER, 1)
    return (
        raw_works.select("rec_id", "fetched_at", F.explode(F.array_distinct("referenced_works")).alias("ref_key"))
        .select(
            F.lit("raw_works").alias("ref_table"),
            F.col("rec_id").alias("row_id"),
            F.lit("referenced_works").alias("field"),
            "ref_key",
            F.when(number != "", number).when(F.trim("ref_key") != "", F.concat(F.lit("key:"), "ref_key")).alias("match_key"),
            F.col("fetched_at").alias("ref_time"),
        )
    )


def present_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where("removed_at is null").select(F.lit("links").alias("target_table"), F.col("id").alias("target_key"), F.col("loaded_at").alias("valid_from"))


def present_works(works: DataFrame) -> DataFrame:
    number = F.nullif(F.regexp_extract("label", WORK_NUMBER, 1), F.lit(""))
    return works.where("removed_at is null").select(F.lit("raw_works").alias("target_table"), number.alias("target_key"), F.col("loaded_at").alias("valid_from"))


#: The composite key of all references: which table they point into and what they point at.
KEY = [("ref_table", "target_table"), ("match_key", "target_key")]


def table_references(links: DataFrame, nodes: DataFrame, raw_works: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references, orphans among them) of links and raw_works.

    One composite key of table and key, with simple match: a null or blank key is the null
    mask of rows that hold no reference.
    """
    refs, targets = link_references(links).unionByName(work_references(raw_works)), present_nodes(nodes).unionByName(present_works(works))
    return held_references(refs, KEY), orphan_references(refs, targets, KEY, ref_time="ref_time", target_time="valid_from")


def collection_references(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links (link_seq, collection_id, target_id) whose collection doesn't hold the node.

    A composite key of collection and node with partial match: of a link without a target
    only the collection is looked up, of one without a collection only the target.
    """
    refs = links.select("link_seq", "collection_id", "target_id", "loaded_at")
    live = nodes.where("removed_at is null").select("collection_id", F.col("id").alias("node_id"), F.col("loaded_at").alias("valid_from"))
    orphans = orphan_references(refs, live, [("collection_id", "collection_id"), ("target_id", "node_id")], match="partial", ref_time="loaded_at", target_time="valid_from")
    return orphans.select("link_seq", "collection_id", "target_id")
