"""Best representative of each duplicate group (problem 4).

Fields with a declared order of trust are decided by that order. All other fields are
decided by currency: which value replaces which is learned from the rows that carry a
timestamp, over all groups; every group then has a partial order of its values (by their
timestamps, and by what was learned where timestamps are missing), and the topologically
latest value survives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.forms import visual_forms
from canopy.session import cut

#: Stand-ins that say a title or an abstract is missing, in lower case and
#: without outer brackets and final stops.
STAND_INS = [
    "-", "--", "n/a", "na", "none", "null", "nil", "unknown", "untitled", "untitled document", "no title", "title not available", "title pending", "title unavailable", "title missing", "title: none",
    "abstract not available", "no abstract", "no abstract available", "this item has no abstract", "abstract: none", "abstract missing", "abstract unavailable", "abstract pending", "not available",
]

#: Words that say that something is missing, and words for the field itself.
ABSENT = r"\b(?:no|not|none|without|missing|unavailable|pending|lacks?|lacking|absent|unknown)\b"
SPOKEN_OF = {"title": r"\b(?:title|titled|untitled)\b", "abstract": r"\b(?:abstract|summary)\b"}
#: Parameters: a text of at most BRIEF characters that speaks of its own field as missing is
#: learned to be a stand-in if it stands in at least SPREAD groups that aren't linked.
BRIEF, SPREAD = 160, 3

#: Parameters: a transition a -> b is learned if it was seen at least SEEN times and at
#: least MARGIN times as often as b -> a.
SEEN, MARGIN = 3, 2.0

#: Fields of a works row decided by currency.
CURRENT_FIELDS = ["year", "venue", "type", "venue_type", "publisher", "institution", "volume", "issue", "page", "doi", "permalink"]


def is_stand_in(form: Column) -> Column:
    """True for a form that only says that there is no value."""
    return F.regexp_replace(F.lower(form), r"^[\[(\s]+|[\])\s.]+$", "").isin(STAND_INS) | F.regexp_replace(form, r"[\[\]().\s\-–—]", "").isin("")


def transitions(rows: DataFrame, group: str, time: str, fields: list[str]) -> DataFrame:
    """(field, older, newer): values of a field of which the second is learned to replace the first.

    In every group the different values of a field are put in the order in which they were
    last stamped; each value and the next one is a transition, and transitions are counted
    over all groups. Rows are reduced to values before the shuffle, so a group of many
    rows is no longer than its values are many. Values are compared as strings; null and
    blank ones are skipped. The result follows the number of different values, so it is
    joined, never broadcast by hand.
    """
    values = _long(rows.where(F.col(time).isNotNull()), [group, time], fields).groupBy(group, "field", "value").agg(F.max(time).alias("at"))
    order = Window.partitionBy(group, "field").orderBy("at", "value")
    steps = values.select("field", F.lag("value").over(order).alias("older"), F.col("value").alias("newer"), "at", F.lag("at").over(order).alias("before")).where("before < at")
    seen = steps.groupBy("field", "older", "newer").agg(F.count(F.lit(1)).alias("n"))
    back = seen.select("field", F.col("older").alias("newer"), F.col("newer").alias("older"), F.col("n").alias("m"))
    return seen.join(back, ["field", "older", "newer"], "left").where((F.col("n") >= SEEN) & (F.col("n") >= MARGIN * F.coalesce("m", F.lit(0)))).select("field", "older", "newer")


def _long(rows: DataFrame, keep: list[str], fields: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return rows.select(*keep, F.inline(cells)).where("trim(value) <> ''")


def current_values(rows: DataFrame, group: str, time: str, fields: list[str], learned: DataFrame) -> DataFrame:
    """(group, field, value, work_id): the topologically latest value of each field of a group.

    A value is overtaken by a later-stamped value if it has a stamp itself, and by any
    value of its group that is learned to replace it if one of the two has no stamp. Of
    the values left (of all, should a ring leave none), the one with a stamp, the latest
    stamp, most rows, then the smallest work_id survives; work_id is the smallest row that
    holds it. Fields without a value give no row.
    """
    long = _long(rows, [group, time, "work_id"], fields)
    values = long.groupBy(group, "field", "value").agg(F.max(time).alias("at"), F.count(F.lit(1)).alias("n"), F.min("work_id").alias("work_id"))
    newest = values.groupBy(group, "field").agg(F.max("at").alias("newest"), F.count(F.lit(1)).alias("kinds"))
    values = values.join(newest, [group, "field"])
    some = values.where("kinds > 1").select(group, "field", "value", "at")
    newer = some.select(group, "field", F.col("value").alias("newer"), F.col("at").alias("at2"))
    overtaken = (
        some.withColumnRenamed("value", "older").join(learned, ["field", "older"]).join(newer, [group, "field", "newer"]).where("at is null or at2 is null").select(group, "field", F.col("older").alias("value")).distinct().withColumn("late", F.lit(1))
    )
    ranked = values.join(overtaken, [group, "field", "value"], "left")
    kept = F.when(F.coalesce(F.col("at") < F.col("newest"), F.lit(False)) | F.col("late").isNotNull(), 0).otherwise(1)
    best = F.max(F.struct(kept.alias("kept"), F.col("at").isNotNull().alias("stamped"), "at", "n", (-F.col("work_id")).alias("first"), "value"))
    return ranked.groupBy(group, "field").agg(best.alias("b")).select(group, "field", F.col("b.value").alias("value"), (-F.col("b.first")).alias("work_id"))


def closed(learned: DataFrame) -> DataFrame:
    """The learned transitions with all that follow from chains of them.

    Chains are doubled until no pair is new; values that lead to each other both ways are
    left undecided.
    """
    known = cut(learned)
    size = known.count()
    while size:
        step = known.select("field", F.col("older").alias("newer"), F.col("newer").alias("next"))
        known = cut(known.union(known.join(step, ["field", "newer"]).where("older <> next").select("field", "older", F.col("next").alias("newer"))).distinct())
        size, before = known.count(), size
        if size == before:
            break
    return known.join(known.toDF("field", "newer", "older"), ["field", "older", "newer"], "left_anti")


def learned_stand_ins(forms: DataFrame) -> DataFrame:
    """(field, plain): brief texts that speak of their own field as missing and stand in many groups.

    forms: group_id, field, plain (the form in lower case). Only such texts are counted.
    """
    says = reduce(lambda a, b: a | b, [(F.col("field") == f) & F.col("plain").rlike(words) for f, words in SPOKEN_OF.items()])
    brief = forms.where((F.char_length("plain") <= BRIEF) & F.col("plain").rlike(ABSENT) & says)
    return brief.select("field", "plain", "group_id").distinct().groupBy("field", "plain").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SPREAD).select("field", "plain")


def text_lengths(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(work_id, field, size) of each usable text: its characters in problem 2's form.

    rows: work_id, group_id and the fields. Stand-ins are those of STAND_INS and those that
    the texts of all groups teach.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    texts = rows.select("work_id", "group_id", F.inline(cells)).where(F.trim("text") != "")
    forms = visual_forms(texts, ["work_id", "field", "group_id"], "text").where((F.col("form") != "") & ~is_stand_in(F.col("form")))
    # What is longer than a stand-in can be has no text to compare.
    plain = F.when(F.char_length("form") <= BRIEF, F.lower("form"))
    sized = cut(forms.select("work_id", "field", "group_id", F.char_length("form").alias("size"), plain.alias("plain")))
    told = sized.where("plain is not null").join(learned_stand_ins(sized), ["field", "plain"], "left_anti")
    return told.unionByName(sized.where("plain is null")).select("work_id", "field", "size")


def suppliers(works: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, field, work_id) for title, abstract and times_cited.

    works: rows of the works table; groups: (work_id, group_id). The longest usable text
    wins, then rich, later updated_at (null is oldest), smaller work_id; the same order
    without length for times_cited, of which values of zero or more are usable. Groups
    without a usable value give no row for the field. All maxima are aggregated before the
    shuffle, so a group of any size is never gathered.
    """
    rows = cut(works.select("work_id", "title", "abstract", "times_cited", "rich", "updated_at").join(groups, "work_id"))
    trust = ["work_id", "group_id", "rich", "updated_at"]
    sized = text_lengths(rows, ["title", "abstract"]).join(rows.select(*trust), "work_id")
    cited = rows.where("times_cited >= 0").select(*trust, F.lit("times_cited").alias("field"), F.lit(0).alias("size"))
    order = F.struct("size", F.coalesce("rich", F.lit(False)).alias("rich"), "updated_at", (-F.col("work_id")).alias("first"))
    return sized.unionByName(cited).groupBy("group_id", "field").agg(F.max(order).alias("o")).select("group_id", "field", (-F.col("o.first")).alias("work_id"))


def merged_records(works: DataFrame, groups: DataFrame) -> DataFrame:
    """One record per group: group_id, n_rows, rich, title, abstract, times_cited and the
    fields of CURRENT_FIELDS (as strings; null where no row has a value)."""
    chosen = suppliers(works, groups)
    rows = works.select("work_id", "rich", "updated_at", *CURRENT_FIELDS).join(groups, "work_id")
    whole = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_rows"), F.bool_or(F.coalesce("rich", F.lit(False))).alias("rich"))
    texts = works.select("work_id", "title", "abstract", F.col("times_cited").cast("string").alias("times_cited"))
    given = chosen.join(texts, "work_id").select("group_id", "field", F.when(F.col("field") == "title", F.col("title")).when(F.col("field") == "abstract", F.col("abstract")).otherwise(F.col("times_cited")).alias("value"))
    learned = closed(transitions(rows, "group_id", "updated_at", CURRENT_FIELDS))
    current = current_values(rows, "group_id", "updated_at", CURRENT_FIELDS, learned).select("group_id", "field", "value")
    names = ["title", "abstract", "times_cited", *CURRENT_FIELDS]
    wide = given.unionByName(current).groupBy("group_id").agg(*[F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in names])
    return whole.join(wide, "group_id", "left").withColumn("times_cited", F.col("times_cited").cast("long"))
