"""Full-text search with BM25 over four fields of works."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions import text as X
from canopy.session import cut, ship

FIELDS = ["title", "abstract", "keywords", "authors"]
#: Fixed values of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def postings(works: DataFrame, key: str, stemmed: bool = True) -> DataFrame:
    """(key, col, pos, term): every index term of the four fields, lists as their JSON text."""
    ship(works.sparkSession)
    kinds = dict(works.dtypes)
    cells = [F.struct(F.lit(c).alias("col"), (F.to_json(c) if kinds[c].startswith("array") else F.col(c)).alias("text")) for c in FIELDS if c in kinds]
    texts = works.select(key, F.inline(F.array(*cells))).where("text is not null")
    return texts.select(key, "col", F.posexplode(X.terms(F.col("text"), stemmed)).alias("pos", "term"))


def indexed(works: DataFrame, key: str, stemmed: bool = True) -> DataFrame:
    """(key, terms): the index terms of each of the four fields that `works` has, in order.

    This is what a store keeps beside its works, so that a search reads terms and no texts.
    """
    ship(works.sparkSession)
    kinds = dict(works.dtypes)
    text = lambda c: F.to_json(c) if kinds[c].startswith("array") else F.col(c)
    none = F.array().cast("array<string>")
    return works.select(key, F.array(*[F.coalesce(X.terms(text(c), stemmed), none) for c in FIELDS if c in kinds]).alias("terms"))


def _uses(phrase: list[str]) -> Column:
    """How often the terms of a phrase stand next to each other in one field."""
    wanted, n = F.array(*map(F.lit, phrase)), len(phrase)
    starts = lambda f: F.filter(F.sequence(F.lit(1), F.size(f) - n + 1), lambda i: F.slice(f, i, n) == wanted)
    # Most fields don't hold the first term at all.
    in_field = lambda f: F.when(F.array_contains(f, phrase[0]) & (F.size(f) >= n), F.size(starts(f))).otherwise(0)
    return F.aggregate("terms", F.lit(0), lambda total, f: total + in_field(f))


def bm25_index(index: DataFrame, key: str, query: str, stemmed: bool = True) -> DataFrame:
    """(key, score) as of bm25() from an index (key, terms).

    Every row is looked at once, without a shuffle; only counts leave it.
    """
    phrases = X.query_phrases(query, stemmed)
    if not phrases:
        return index.select(key).where(F.lit(False)).withColumn("score", F.lit(0.0))
    size = F.aggregate("terms", F.lit(0), lambda total, f: total + F.size(f))
    rows = cut(index.select(key, size.alias("size"), F.array(*map(_uses, phrases)).alias("f")))
    known = rows.agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("terms"), *[F.count_if(F.col("f")[i] > 0).alias(f"n{i}") for i in range(len(phrases))])
    # One row.
    hits = rows.where(~F.exists("f", lambda x: x == 0)).crossJoin(F.broadcast(known))
    length = 1 - B + B * F.col("size") / (F.col("terms") / F.col("docs"))
    parts = []
    for i in range(len(phrases)):
        idf = F.log((F.col("docs") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        f = F.col("f")[i]
        parts.append(F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF)) * (f * (K1 + 1)) / (f + K1 * length))
    return hits.select(key, (-reduce(lambda a, b: a + b, parts)).alias("score"))


def bm25(works: DataFrame, key: str, query: str, stemmed: bool = True) -> DataFrame:
    """(key, score) of works in which every part of the query stands; the lower, the better.

    Document counts and lengths are over all given works, with every field weighing the
    same. A query without a term gives no rows.
    """
    return bm25_index(indexed(works, key, stemmed), key, query, stemmed)


def search_index(index: DataFrame, nodes: DataFrame, query: str, limit: int, stemmed: bool = True) -> DataFrame:
    """As search_collection(), from an index (label, terms)."""
    hits = bm25_index(index, "label", query, stemmed).join(nodes.select(F.col("work_label").alias("label")).distinct(), "label", "left_semi")
    return hits.orderBy("score", "label").limit(max(limit, 0))


def search_collection(works: DataFrame, nodes: DataFrame, query: str, limit: int, stemmed: bool = True) -> DataFrame:
    """(label, score): the best matches that are nodes (work_label) of one collection, ties by label.

    Ranks over all works, then keeps the collection's, then limits.
    """
    return search_index(indexed(works, "label", stemmed), nodes, query, limit, stemmed)
