"""Works that share identifiers: duplicate groups, merging, and canonical citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.operators.components import connected_components
from canopy.session import cut

#: Fields of which the first known value wins, rich works before stubs.
FIRST_KNOWN = ["year", "title", "venue", "type", "venue_type", "publisher", "institution", "volume", "issue", "page", "doi", "permalink", "times_cited", "abstract"]


def id_components(works: DataFrame, key: str, ids: str = "ids") -> DataFrame:
    """(key, component): works that share an identifier, directly or indirectly; component is
    the smallest key. Works without identifiers are left out. Identifiers compare exactly."""
    tokens = works.select(key, F.explode(F.array_distinct(F.array_compact(ids))).alias("id"))
    first = tokens.groupBy("id").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"))
    edges = tokens.join(first.where("n > 1"), "id").select(F.col("first").alias("src"), F.col(key).alias("dst"))
    return connected_components(edges, tokens.select(F.col(key).alias("id")).distinct()).select(F.col("id").alias(key), "component")


def merge_groups(works: DataFrame, group: str, order: str) -> DataFrame:
    """One work per value of `group`, from the works in it (columns of the work model).

    The longest label (of equally long ones the smaller), all identifiers and keywords,
    the longest list of authors (ties: rich works, then `order`), the first known value of
    other fields with rich works first, then in `order`; rich if any work is. `order` must
    be unique in a group. Aggregated before the shuffle field by field.
    """
    rank = F.struct((~F.coalesce("rich", F.lit(False))).cast("int").alias("r"), F.col(order).alias("o"))
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c)
    sets = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.col(c))))).alias(c)
    label = F.min(F.struct((-F.octet_length("label")).alias("n"), F.col("label").alias("l")))
    authors = F.min_by("authors", F.struct((-F.coalesce(F.size("authors"), F.lit(0))).alias("n"), rank.alias("k")))
    merged = works.groupBy(group).agg(label.alias("_l"), sets("ids"), authors.alias("authors"), *[first(c) for c in FIRST_KNOWN], sets("keywords"), F.bool_or(F.coalesce("rich", F.lit(False))).alias("rich"), F.min(order).alias("pos"))
    return merged.withColumn("label", F.col("_l.l")).drop("_l")


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row per value of `key`: a rich one if there is, then the one whose other columns compare
    greatest, so that the same rows always give the same one. Reduced before the shuffle."""
    rest = [c for c in df.columns if c != key]
    best = F.max(F.struct(*([F.coalesce("rich", F.lit(False)).alias("_rich")] if "rich" in rest else []), *rest))
    return df.groupBy(key).agg(best.alias("_best")).select(*[F.col(c if c == key else f"_best.{c}").alias(c) for c in df.columns])


def deduplicate(works: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(merged works, members): one work per identifier component, and (key, component)."""
    members = cut(id_components(works, key))
    return merge_groups(works.join(members, key), "component", key), members


def canonical_citations(citations: DataFrame, canonical: DataFrame) -> DataFrame:
    """Citations (src, dst, pos) between canonical works: canonical has (id, component).

    Ends without a canonical work are dropped; of repeated citations the first place stays.
    """
    ends = lambda c: canonical.select(F.col("id").alias(c), F.col("component").alias(f"{c}_c"))
    return citations.join(ends("src"), "src").join(ends("dst"), "dst").groupBy(F.col("src_c").alias("src"), F.col("dst_c").alias("dst")).agg(F.min("pos").alias("pos"))


def references_by_id(references: DataFrame, ids: DataFrame, key: list[str], keep: bool = True) -> DataFrame:
    """The references (unique by `key`, with an ids list) that have an identifier in `ids`
    (column id), or with keep = False those that have none."""
    hit = references.select(*key, F.explode("ids").alias("id")).join(ids.select("id").distinct(), "id", "left_semi").select(*key).distinct()
    return references.join(hit, key, "left_semi" if keep else "left_anti")


def enrich(stubs: DataFrame, fetched: DataFrame, source: str = "openalex") -> DataFrame:
    """Referenced works with what was fetched for them.

    Stubs with an identifier of `source` become the fetched work with it, and are dropped
    if none was fetched; rich ones and those without such an identifier stay.
    """
    from canopy.functions.scalar import id_of

    columns = stubs.columns
    keyed = stubs.withColumn("_k", id_of(F.col("ids"), source))
    new = fetched.withColumn("_k", id_of(F.col("ids"), source)).where("_k is not null").select("_k", *columns)
    new = one_per_key(new, "_k").select("_k", F.struct(*columns).alias("_new"))
    hit = keyed.join(new, "_k", "left").where("coalesce(rich, false) or _k is null or _new is not null")
    use = F.coalesce(F.col("rich"), F.lit(False)) | F.col("_new").isNull()
    return hit.select(*[F.when(use, F.col(c)).otherwise(F.col(f"_new.{c}")).alias(c) for c in columns])
