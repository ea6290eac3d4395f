"""A live catalogue behind HTTP as a Spark data source.

    spark.dataSource.register(CatalogueSource)
    spark.read.format("catalogue").options(base_url=..., query="...", limit=200).load()

Requests are spread over at most AT_ONCE partitions, so no more run at a time; rows carry
the request and place they came from, by which the answers' order is restored. Any failed
request fails the read.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import IntegerType, StructType

from canopy.session import ship
from canopy.sources.works import AT_ONCE, PER_LOOKUP, PER_PAGE

#: Parameters: tries of a request, and the shortest and longest wait before another one.
TRIES, WAIT, LONGEST = 4, 1.0, 10.0


def search_requests(query: str, limit: int, select: list[str]) -> list[dict[str, str]]:
    """The page requests for a query: works with references, citations and an abstract, by relevance."""
    words = query.replace(",", " ").replace(":", " ").split()
    wanted = [f"title_and_abstract.search:{'+'.join(words)}", "referenced_works_count:>0", "cited_by_count:>1", "has_abstract:true"]
    base = {"select": ",".join(select), "filter": ",".join(wanted), "sort": "relevance_score:desc", "per_page": str(PER_PAGE)}
    return [base | {"page": str(n + 1)} for n in range(-(-limit // PER_PAGE))]


def lookup_requests(ids: list[str], select: list[str]) -> list[dict[str, str]]:
    """The requests for works by id, PER_LOOKUP ids in each."""
    chunks = [ids[i : i + PER_LOOKUP] for i in range(0, len(ids), PER_LOOKUP)]
    return [{"select": ",".join(select), "filter": f"ids.openalex:{'|'.join(c)}", "per_page": str(PER_LOOKUP)} for c in chunks]


def fetch(url: str, headers: dict[str, str]) -> dict:
    """The decoded answer; busy and failing servers (429, 5xx) and lost connections are tried again."""
    for attempt in range(TRIES):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=60) as answer:
                return json.load(answer)
        except urllib.error.HTTPError as e:
            if attempt == TRIES - 1 or not (e.code == 429 or e.code >= 500):
                raise
        except urllib.error.URLError:
            if attempt == TRIES - 1:
                raise
        time.sleep(min(WAIT * 2**attempt, LONGEST))
    raise AssertionError("unreachable")


def headers_of(options: dict[str, str]) -> dict[str, str]:
    """The request headers that options name as header.NAME and email."""
    headers = {k[len("header.") :]: v for k, v in options.items() if k.startswith("header.")}
    return headers | ({"User-Agent": f"canopy (mailto:{options['email']})"} if options.get("email") else {})


def works_url(options: dict[str, str], asked: dict[str, str]) -> str:
    return f"{options['base_url'].rstrip('/')}/works?{urllib.parse.urlencode(asked, safe='+:|,>')}"


def _shaped(value, kind):
    """A JSON value in the shape of a Spark type; what the type doesn't know is dropped."""
    if value is None:
        return None
    name = kind.typeName()
    if name == "struct":
        return tuple(_shaped(value.get(f.name), f.dataType) for f in kind.fields)
    if name == "array":
        return [_shaped(v, kind.elementType) for v in value]
    if name == "map":
        return {str(k): _shaped(v, kind.valueType) for k, v in value.items()}
    return str(value) if name == "string" else int(value) if name in ("integer", "long") else float(value) if name == "double" else value


@dataclass
class Requests(InputPartition):
    """Numbered requests that one task sends one after another."""

    numbered: list = field(default_factory=list)


class CatalogueReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[Requests]:
        select = [f.name for f in self.schema.fields if f.name not in ("request", "pos")]
        asked = search_requests(self.options["query"], int(self.options.get("limit", PER_PAGE)), select)
        numbered = list(enumerate(asked))
        parts = [numbered[i::AT_ONCE] for i in range(AT_ONCE)]
        return [Requests(p) for p in parts if p] or [Requests([])]

    def read(self, partition: Requests) -> Iterator[tuple]:
        headers = headers_of(self.options)
        for number, asked in partition.numbered:
            answer = fetch(works_url(self.options, asked), headers)
            for pos, work in enumerate(answer.get("results") or []):
                yield tuple({"request": number, "pos": pos}.get(f.name) if f.name in ("request", "pos") else _shaped(work.get(f.name), f.dataType) for f in self.schema.fields)


class CatalogueSource(DataSource):
    """Options: base_url, query, limit, email and header.NAME."""

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self):
        raise NotImplementedError("give the schema of raw records")

    def reader(self, schema: StructType) -> CatalogueReader:
        return CatalogueReader(schema, dict(self.options))


class LiveCatalogue:
    """Searches and lookups against a live catalogue, in place of an offline snapshot."""

    def __init__(self, spark: SparkSession, base_url: str, **options: str):
        ship(spark)
        spark.dataSource.register(CatalogueSource)
        self.spark, self.options = spark, {"base_url": base_url} | options

    def _load(self, **options: str) -> DataFrame:
        from canopy.schema import RAW

        fields = self.spark.createDataFrame([], RAW).schema
        schema = StructType([*fields.fields]).add("request", IntegerType()).add("pos", IntegerType())
        return self.spark.read.format("catalogue").schema(schema).options(**self.options | options).load()

    def search(self, query: str, limit: int) -> DataFrame:
        """At most `limit` works, in the catalogue's order of relevance."""
        return self._load(query=query, limit=str(limit)).orderBy("request", "pos").limit(max(limit, 0)).drop("request", "pos")

    def lookup(self, ids: DataFrame) -> DataFrame:
        """The works with the given ids (column id), asked for by at most AT_ONCE tasks."""
        from canopy.schema import RAW

        fields, options = [f.name for f in self.spark.createDataFrame([], RAW).schema], self.options

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for asked in lookup_requests(batch.column(0).to_pylist(), fields):
                    found = fetch(works_url(options, asked), headers_of(options)).get("results") or []
                    yield pa.RecordBatch.from_arrays([pa.array([json.dumps(w) for w in found], pa.string())], names=["work"])

        names = ids.select("id").where("id is not null").distinct().repartition(AT_ONCE)
        return names.mapInArrow(ask, "work string").select(F.from_json("work", RAW).alias("w")).select("w.*")
