"""Reading raw scholarly records and turning them into works and citations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import scalar as S
from canopy.functions import text as X
from canopy.schema import RAW, WORK_COLUMNS

#: The shapes of requests to the catalogue.
PER_PAGE, PER_LOOKUP, AT_ONCE = 200, 50, 4


def read_raw(spark: SparkSession, path: str, format: str = "json", **options) -> DataFrame:
    """Raw records with a declared schema; only the columns that are used are parsed or read."""
    return spark.read.schema(RAW).options(**options).format(format).load(path)


def read_pages(spark: SparkSession, path: str, **options) -> DataFrame:
    """Raw records out of answer pages, in page order: RAW columns, page and pos."""
    fields = spark.createDataFrame([], RAW).schema
    page = "meta struct<count: int, page: int, per_page: int>, results " + f"array<{fields.simpleString()}>"
    pages = spark.read.schema(page).options(**options).json(path)
    return pages.select(F.col("meta.page").alias("page"), F.posexplode("results").alias("pos", "r")).select("page", "pos", "r.*")


def to_works(raw: DataFrame) -> DataFrame:
    """Flat works of raw records. abstract and times_cited are never null ('' and 0), rich is true.

    A null id leaves the label null; identifiers of source doi lose their resolver prefix.
    """
    ids = F.transform(F.map_entries("ids"), lambda e: F.concat(e["key"], F.lit(":"), F.when(e["key"] == "doi", S.extract_doi(e["value"])).otherwise(e["value"])))
    source = S.venue_source(F.col("primary_location"), F.col("locations"))
    return raw.select(
        F.col("id").alias("label"),
        F.array_sort(F.array_distinct(F.array_compact(F.coalesce(ids, F.array().cast("array<string>"))))).alias("ids"),
        F.transform("authorships", lambda a: S.invert_name(a["author"]["display_name"])).alias("authors"),
        F.col("publication_year").alias("year"),
        "title",
        source["display_name"].alias("venue"),
        S.non_empty(F.col("type")).alias("type"),
        S.non_empty(source["type"]).alias("venue_type"),
        source["host_organization_name"].alias("publisher"),
        S.first_institution(F.col("authorships")).alias("institution"),
        F.col("biblio.volume").alias("volume"),
        F.col("biblio.issue").alias("issue"),
        S.page_range(F.col("biblio.first_page"), F.col("biblio.last_page")).alias("page"),
        S.extract_doi(F.col("doi")).alias("doi"),
        F.col("primary_location.landing_page_url").alias("permalink"),
        F.coalesce("cited_by_count", F.lit(0)).alias("times_cited"),
        F.array_sort(F.array_distinct(F.transform(F.coalesce("keywords", F.array()), lambda k: k["display_name"]))).alias("keywords"),
        S.invert_abstract(F.col("abstract_inverted_index")).alias("abstract"),
        F.lit(True).alias("rich"),
    )


def reference_stubs(references: DataFrame, column: str = "dst") -> DataFrame:
    """A stub work for each distinct reference: label, one id, rich = false, all else null."""
    ref = references.select(F.col(column).alias("label")).where("label is not null").distinct()
    have = {"label": F.col("label"), "ids": F.array(F.concat(F.lit("openalex:"), F.col("label"))), "rich": F.lit(False)}
    from pyspark.sql.types import _parse_datatype_string

    from canopy.schema import WORK

    kinds = {f.name: f.dataType for f in _parse_datatype_string(WORK).fields}
    return ref.select(*[have.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in WORK_COLUMNS])


def citations(raw: DataFrame) -> DataFrame:
    """(src, dst, pos): each record's references in order."""
    return raw.select(F.col("id").alias("src"), F.posexplode("referenced_works").alias("pos", "dst")).select("src", "dst", "pos")


def work_numbers(raw: DataFrame) -> DataFrame:
    """(src, dst): distinct citations by the number at the end of the keys, however they are written."""
    number = lambda c: F.concat(F.lit("W"), F.nullif(F.regexp_extract(c, r"[Ww]([0-9]+)\s*$", 1), F.lit("")))
    return raw.select(number(F.col("id")).alias("src"), F.explode("referenced_works").alias("r")).select("src", number(F.col("r")).alias("dst")).dropna().distinct()


@dataclass
class Snapshot:
    """An offline catalogue: raw records by which searches and lookups are answered."""

    raw: DataFrame

    def search(self, query: str, limit: int) -> DataFrame:
        """Seeds of a query: records with references, citations and an abstract that hold all
        its words in title or abstract; most word hits first, then most cited, then id."""
        words = [p for part in X.query_phrases(query.replace(",", " ").replace(":", " "), stemmed=False) for p in part]
        text = F.concat_ws(" ", "title", S.invert_abstract(F.col("abstract_inverted_index")))
        base = self.raw.where((F.size("referenced_works") > 0) & (F.col("cited_by_count") > 1) & F.col("abstract_inverted_index").isNotNull())
        found = X.words(text)
        hits = F.size(F.filter(found, lambda w: w.isin(words))) if words else F.lit(0)
        every = F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.array_contains(found, w)) if words else F.lit(False)
        return base.where(every).withColumn("_hits", hits).orderBy(F.desc("_hits"), F.desc("cited_by_count"), "id").limit(max(limit, 0)).drop("_hits")

    def lookup(self, ids: DataFrame) -> DataFrame:
        """The records whose id is in `ids` (column id)."""
        return self.raw.join(ids.select("id").distinct(), "id", "left_semi")
