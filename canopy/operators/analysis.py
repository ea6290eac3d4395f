"""Scored nodes and weighted links of analysed collections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import scalar as S

SCORES = {"root": "rootness", "trunk": "trunkness", "leaf": "leafness"}


def score_of(category: str) -> str:
    """The score column of a category; an unknown category counts as root."""
    return SCORES.get(category, "rootness")


def number(score: str) -> Column:
    """A score that is a number above 0, else null."""
    return F.when(~F.isnan(score) & (F.col(score) > 0), F.col(score))


def current_nodes(nodes: DataFrame) -> DataFrame:
    """The latest delivery of each node, without removed ones (ties: the greater scores)."""
    rest = ["collection_id", "work_label", "category", "rootness", "trunkness", "leafness", "removed_at"]
    latest = nodes.groupBy("id").agg(F.max(F.struct("loaded_at", *rest)).alias("n"))
    return latest.select("id", "n.*").where("removed_at is null").drop("removed_at", "loaded_at")


def current_links(links: DataFrame) -> DataFrame:
    """(collection_id, source_id, target_id, weight): the last delivery of each link wins, weight
    null or 0 is 1; links without an end are left out."""
    known = links.where("trim(source_id) <> '' and trim(target_id) <> ''")
    last = known.groupBy("collection_id", "source_id", "target_id").agg(F.max_by("weight", F.struct("loaded_at", "link_seq")).alias("weight"))
    return last.withColumn("weight", F.coalesce(F.nullif("weight", F.lit(0.0)), F.lit(1.0)))


def top_by_category(nodes: DataFrame, category: str, limit: int, per: list[str] | None = None) -> DataFrame:
    """The best nodes of a category (per value of `per`) with score and normalised score.

    Filters by score, not by the category column; ties go by work_label, then id. A limit of
    0 or less gives no rows. Over all of `nodes` the limit is a distributed top n.
    """
    score = score_of(category)
    scored = nodes.withColumn("score", number(score)).where("score is not null")
    order = [F.desc("score"), "work_label", "id"]
    if per:
        scored = scored.withColumn("place", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("place") <= max(limit, 0))
        top = F.max("score").over(Window.partitionBy(*per))
    else:
        scored = scored.orderBy(*order).limit(max(limit, 0))
        top = F.max("score").over(Window.partitionBy(F.lit(1)))
    return scored.withColumn("normal", S.normalize_score(F.col("score"), top))


def normalized(nodes: DataFrame, per: str | None = "collection_id") -> DataFrame:
    """Nodes with every score normalised by its maximum in the collection; per = None: in all nodes."""
    tops = (nodes.groupBy(per) if per else nodes).agg(*[F.max(number(s)).alias(f"_{s}") for s in SCORES.values()])
    wide = nodes.join(tops, per) if per else nodes.crossJoin(F.broadcast(tops))  # without a group, one row
    out = {s: S.normalize_score(F.coalesce(number(s), F.lit(0.0)), F.coalesce(f"_{s}", F.lit(0.0))) for s in SCORES.values()}
    return wide.withColumns(out).drop(*[f"_{s}" for s in SCORES.values()])


@dataclass
class Analysis:
    """nodes (id, category, scores, work_label, ...) and links (source, target, weight)."""

    nodes: DataFrame
    links: DataFrame

    def keep(self, ids: DataFrame) -> Analysis:
        """The nodes of `ids` (column id) and the links of which both ends stay."""
        ids = ids.select("id").distinct()
        links = self.links.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
        return Analysis(self.nodes.join(ids, "id", "left_semi"), links)

    def normalize(self) -> Analysis:
        return Analysis(normalized(self.nodes, None), self.links)


def aliases(nodes: DataFrame, node: str = "node") -> DataFrame:
    """(node, alias): every name under which a stored work can be asked for, in lower case.

    nodes: node, id, label, authors, year, doi, ids. An alias has a letter for what it may
    equal: r for whole names, d for DOIs, x for identifiers with or without their source,
    o for catalogue numbers.
    """
    mark = lambda kind, c: F.concat(F.lit(kind), c)
    bare = lambda x: F.when(x.contains(":"), F.regexp_replace(x, r"^[^:]*:", ""))
    number_ = lambda x: F.nullif(F.regexp_replace(F.regexp_replace(x, "^openalex:", ""), r"^https://openalex\.org/", ""), F.lit(""))
    whole = F.array(mark("r", F.col("id")), mark("r", F.col("label")), mark("r", S.simple_id(F.col("authors"), F.col("year"))), mark("d", S.extract_doi(S.non_empty(F.col("doi")))))
    each = F.flatten(F.transform(F.coalesce("ids", F.array().cast("array<string>")), lambda x: F.array(mark("x", x), mark("x", bare(x)), mark("o", number_(x)))))
    return nodes.select(node, F.explode(F.array_distinct(F.array_compact(F.concat(whole, each)))).alias("a")).select(node, F.lower("a").alias("alias")).distinct()


def asked_aliases(targets: DataFrame) -> DataFrame:
    """(pos, target, alias) of requested names (pos, target); blank ones are left out."""
    t = F.col("target")
    bare = F.when(t.contains(":"), F.regexp_replace(t, r"^[^:]*:", ""))
    number_ = F.nullif(F.regexp_replace(F.regexp_replace(t, "^openalex:", ""), r"^https://openalex\.org/", ""), F.lit(""))
    names = F.array(F.concat(F.lit("r"), t), F.concat(F.lit("d"), S.extract_doi(t)), F.concat(F.lit("x"), t), F.concat(F.lit("x"), bare), F.concat(F.lit("o"), number_))
    asked = targets.withColumn("target", S.trimmed(t)).where("target <> ''")
    return asked.select("pos", "target", F.explode(F.array_distinct(F.array_compact(names))).alias("a")).select("pos", "target", F.lower("a").alias("alias")).distinct()


def find_works(nodes: DataFrame, targets: DataFrame, order: str = "node") -> tuple[DataFrame, DataFrame]:
    """((node, pos) of found works, (pos, target) of names without a work).

    Each requested name finds the first node in `order` with an equal alias; a work found
    by several names counts once, at the first of them. An equi-join of aliases, so the
    cost follows the number of names and not their product.
    """
    asked = asked_aliases(targets)
    hits = asked.join(aliases(nodes, order), "alias").groupBy("pos", "target").agg(F.min(order).alias(order))
    found = hits.groupBy(order).agg(F.min("pos").alias("pos"))
    missing = asked.select("pos", "target").distinct().join(hits, ["pos", "target"], "left_anti")
    return found, missing
