"""The service: building, storing, querying and searching collections of works."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from canopy.functions import scalar as S
from canopy.functions import text as X
from canopy.operators import analysis as A
from canopy.operators import dedup, graph, sap, steiner
from canopy.operators import search as full_text
from canopy.session import cut
from canopy.sources import works as W
from canopy.sources.store import Store
from canopy.schema import TABLES, WORK_COLUMNS

#: Parameters: collections that a listing shows, and the share of the limit below which seeds are few.
LISTED, FEW = 10_000, 0.5
PRESETS = ("tos", "roots", "trunks", "leaves", "top_cited")


class CollectionNotFound(LookupError):
    """No collection has that id or name."""


class CollectionExists(ValueError):
    """Another collection has that fingerprint or name."""


@dataclass
class Inquiry:
    """What inquire() did: the collection, whether it was built now, from how many seeds."""

    collection: Row
    is_new: bool
    seed_count: int

    def warnings(self, limit: int) -> list[str]:
        few = self.is_new and self.seed_count < FEW * limit
        return [f"only {self.seed_count} of {limit} seeds were found; try a broader query"] if few else []


def normal_query(query: str) -> str:
    return re.sub(r"\s+", " ", query.strip().lower())


def fingerprint(query: str, limit: int, version: int = S.FINGERPRINT_VERSION) -> str:
    """Hex SHA-256 by which a stored collection is found again; as the column function."""
    text = json.dumps({"version": version, "limit": limit, "query": normal_query(query)}, separators=(",", ":"), ensure_ascii=False)
    for char in "&<>\u2028\u2029":
        text = text.replace(char, f"\\u{ord(char):04x}")
    return hashlib.sha256(text.encode()).hexdigest()


def check_limit(limit: int, most: int | None = None) -> None:
    if limit < 1 or (most is not None and limit > most):
        raise ValueError(f"limit must be from 1 to {most}" if most else "limit must be 1 or more")


class Engine:
    """Collections in a store, fed from an offline catalogue.

    Rows that a method returns as a list are of one collection row or of a bounded listing;
    everything that grows with the works stays a DataFrame.
    """

    def __init__(self, spark: SparkSession, store: Store, catalogue: W.Snapshot | None = None):
        self.spark, self.store, self.catalogue = spark, store, catalogue

    # -- collections --------------------------------------------------------------------

    def _collections(self) -> DataFrame:
        return self.store.table("collections")

    def _one(self, condition) -> Row:
        found = self._collections().where(condition).orderBy(F.desc("created_at"), F.desc("id")).limit(1).collect()
        if not found:
            raise CollectionNotFound
        return found[0]

    def find_by_hash(self, query_hash: str) -> Row:
        return self._one(F.col("query_hash") == query_hash)

    def find_by_id(self, id: str) -> Row:
        return self._one(F.col("id") == id)

    def find_by_name(self, name: str) -> Row:
        return self._one(F.col("name") == name)

    def find_by_query(self, query: str, limit: int) -> Row:
        """The latest collection of a query and limit, of whatever fingerprint version."""
        return self._one((F.col("query") == normal_query(query)) & (F.col("result_limit") == limit))

    def resolve(self, target: str = "") -> Row:
        """The latest collection for '', else the one with that id, else with that name."""
        target = target.strip()
        if not target:
            return self._one(F.lit(True))
        try:
            uuid.UUID(target)
            return self.find_by_id(target)
        except (ValueError, CollectionNotFound):
            return self.find_by_name(target)

    def list(self) -> list[Row]:
        """The newest collections first, at most LISTED."""
        return self._collections().orderBy(F.desc("created_at"), F.desc("id")).limit(LISTED).collect()

    def create(self, query: str, limit: int, name: str | None = None, id: str | None = None, version: int = S.FINGERPRINT_VERSION) -> Row:
        """Store a new collection without works; a taken fingerprint or name raises CollectionExists."""
        h, now = fingerprint(query, limit, version), datetime.now(UTC).replace(tzinfo=None)
        taken = F.col("query_hash") == h
        if name is not None:
            taken = taken | (F.col("name") == name)
        if self._collections().where(taken).limit(1).count():
            raise CollectionExists
        row = self.spark.createDataFrame([(id or str(uuid.uuid4()), h, normal_query(query), limit, None, name, 0, now, now)], TABLES["collections"])
        self._write(cut(self._collections().union(row)))
        return self.find_by_hash(h)

    def _write(self, collections: DataFrame) -> None:
        self.store.put("collections", collections)
        self.store.commit()

    def _changed(self, id: str, **values) -> DataFrame:
        own = F.col("id") == id
        new = {"updated_at": F.lit(datetime.now(UTC).replace(tzinfo=None))} | values
        return cut(self._collections().withColumns({c: F.when(own, v if not isinstance(v, (str, int, type(None))) else F.lit(v)).otherwise(F.col(c)) for c, v in new.items()}))

    def update_name(self, id: str, name: str | None) -> None:
        """Rename a collection; None clears the name."""
        self.find_by_id(id)
        if name is not None and self._collections().where((F.col("name") == name) & (F.col("id") != id)).limit(1).count():
            raise CollectionExists
        self._write(self._changed(id, name=name))

    def update_hash(self, id: str, query_hash: str) -> None:
        self.find_by_id(id)
        self._write(self._changed(id, query_hash=query_hash))

    def delete(self, id: str) -> None:
        """Delete a collection with its nodes and links; its works stay."""
        self.find_by_id(id)
        self.store.drop(id)
        self._write(cut(self._collections().where(F.col("id") != id)))

    # -- building -----------------------------------------------------------------------

    def inquire(self, query: str, limit: int = 200, force: bool = False, name: str | None = None) -> Inquiry:
        """The collection of a query: the stored one if it is current, else built from the catalogue.

        An outdated or forced collection is rebuilt in place under its id, and gets its new
        fingerprint only after the rebuild, so a failed one is tried again. A name of another
        collection raises CollectionExists before anything is fetched; a blank one is ignored.
        """
        if not query.strip():
            raise ValueError("query must not be empty")
        check_limit(limit)
        name = (name or "").strip() or None
        stored, current = None, False
        try:
            stored, current = self.find_by_hash(fingerprint(query, limit)), True
        except CollectionNotFound:
            try:
                stored = self.find_by_query(query, limit)
            except CollectionNotFound:
                pass
        if stored is not None and current and not force:
            return Inquiry(stored, False, 0)
        if name is not None:
            other = self._collections().where((F.col("name") == name) & (F.col("id") != (stored.id if stored else ""))).limit(1).count()
            if other:
                raise CollectionExists
        analysis, seeds = self.analyse(query, limit)
        if stored is None:
            stored = self.create(query, limit, name)
        elif name is not None and name != stored.name:
            self.update_name(stored.id, name)
        self.store_analysis(stored.id, analysis)
        self.update_hash(stored.id, fingerprint(query, limit))
        return Inquiry(self.find_by_id(stored.id), True, seeds)

    def analyse(self, query: str, limit: int) -> tuple[A.Analysis, int]:
        """Fetch, map, deduplicate, clean, enrich, clean again and score: (analysis, seeds)."""
        if self.catalogue is None:
            raise RuntimeError("the engine has no catalogue")
        seeds = cut(self.catalogue.search(query, limit))
        count = seeds.count()
        mains, cites = W.to_works(seeds), cut(W.citations(seeds))
        works, edges = self._collection(mains, cites)
        vertices, edges = self._cleaned(works, edges)
        works = works.join(vertices, "id", "left_semi")
        stubs = works.where("not rich").select(S.id_of(F.col("ids"), "openalex").alias("id")).where("id is not null")
        fetched = W.to_works(self.catalogue.lookup(stubs))
        enriched = cut(dedup.enrich(works.select(*WORK_COLUMNS), fetched))
        keep = enriched.select(F.col("label")).distinct()
        cites = cites.join(keep.withColumnRenamed("label", "src"), "src", "left_semi").join(keep.withColumnRenamed("label", "dst"), "dst", "left_semi")
        works, edges = self._collection(enriched, cites)
        vertices, edges = self._cleaned(works, edges)
        scores = sap.run_sap(vertices, edges)
        nodes = scores.nodes().join(works, "id")
        links = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(1.0).alias("weight"))
        return A.Analysis(cut(nodes), cut(links)), count

    def _collection(self, mains: DataFrame, cites: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Works (with id, their key) and citations between them, duplicates merged.

        Stubs stand for what is cited and not among the works. Keys and citations follow
        the merged works.
        """
        stubs = W.reference_stubs(cites).join(mains.select("label"), "label", "left_anti").select(*WORK_COLUMNS)
        both = cut(dedup.one_per_key(mains.select(*WORK_COLUMNS).unionByName(stubs).where("size(ids) > 0"), "label"))
        merged, members = dedup.deduplicate(both, "label")
        merged = cut(merged.withColumn("id", S.work_key(F.col("ids"))))
        canonical = members.select(F.col("label").alias("id"), "component").join(merged.select("component", F.col("id").alias("key")), "component").select("id", F.col("key").alias("component"))
        edges = cut(dedup.canonical_citations(cites, canonical))
        return merged.select("id", *WORK_COLUMNS), edges

    def _cleaned(self, works: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        vertices, edges = graph.citation_graph(edges, works.where("rich").select("id"))
        return graph.clean(vertices, edges)

    def store_analysis(self, id: str, analysis: A.Analysis) -> None:
        """Replace a collection's nodes and links and upsert its works, visible together.

        A node without a work is stored under its id as label; links with an unknown end
        are dropped, of repeated ones the greatest weight stays, and a null or zero weight
        is 1.
        """
        if analysis is None:
            raise ValueError("analysis must not be null")
        self.find_by_id(id)
        nodes = analysis.nodes
        if "work_label" in nodes.columns and "label" not in nodes.columns:
            nodes = nodes.withColumnRenamed("work_label", "label")
        nodes = cut(nodes.withColumn("label", F.coalesce("label", "id") if "label" in nodes.columns else F.col("id")))
        kinds = {f.name: f.dataType for f in self.store.empty("works").schema}
        have = lambda c: F.col(c).cast(kinds[c]) if c in nodes.columns else F.lit(None).cast(kinds[c])
        new = dedup.one_per_key(nodes.select(*[have(c).alias(c) for c in WORK_COLUMNS]), "label")
        ends = nodes.select("id").distinct()
        links = analysis.links.join(ends.withColumnRenamed("id", "source"), "source", "left_semi").join(ends.withColumnRenamed("id", "target"), "target", "left_semi")
        links = links.groupBy("source", "target").agg(F.max(F.coalesce(F.nullif("weight", F.lit(0.0)), F.lit(1.0))).alias("weight"))
        score = lambda c: F.coalesce(c, F.lit(0.0)).cast("double").alias(c)
        rows = nodes.select(F.lit(id).alias("collection_id"), "id", F.col("label").alias("work_label"), F.coalesce("category", F.lit("")).alias("category"), score("rootness"), score("trunkness"), score("leafness"))
        try:
            self.store.upsert(new)
            self.store.put("nodes", rows, id)
            self.store.put("links", links.select(F.lit(id).alias("collection_id"), "source", "target", "weight"), id)
            self._write(self._changed(id, work_count=rows.count()))
        except Exception:
            self.store.rollback()
            raise

    # -- reading ------------------------------------------------------------------------

    def _nodes(self, id: str) -> DataFrame:
        """Stored nodes with their works; id is the work's key, else its label."""
        works = self.store.table("works").withColumnRenamed("label", "work_label")
        nodes = self.store.table("nodes", id).drop("id").join(works, "work_label")
        return nodes.withColumn("id", F.coalesce(S.work_key(F.col("ids")), "work_label"))

    def load_analysis(self, id: str) -> A.Analysis:
        """A collection's nodes with works and normalised scores, and its links."""
        self.find_by_id(id)
        stored = self.store.table("nodes", id).select(F.col("id").alias("stored"), "work_label")
        nodes = self._nodes(id)
        key = stored.join(nodes.select("work_label", "id"), "work_label")
        links = self.store.table("links", id).select("source", "target", F.coalesce("weight", F.lit(1.0)).alias("weight"))
        for end in ("source", "target"):
            links = links.join(key.select(F.col("stored").alias(end), F.col("id").alias("_k")), end).drop(end).withColumnRenamed("_k", end)
        return A.Analysis(nodes, links.select("source", "target", "weight")).normalize()

    def query_category(self, id: str, category: str, limit: int = 5) -> DataFrame:
        """The best works of a category with score (normalised); unknown categories count as root."""
        top = A.top_by_category(self._nodes(id), category, limit)
        return top.drop("score").withColumnRenamed("normal", "score").orderBy(F.desc("score"), "work_label", "id")

    def search(self, id: str, query: str, limit: int = 10) -> A.Analysis | None:
        """The best full-text matches and the works that connect them; None for a blank query
        or a limit of 0 or less, an empty analysis if nothing matches."""
        if limit <= 0 or not X.query_phrases(query):
            return None
        analysis = self.load_analysis(id)
        hits = full_text.search_index(self.store.table("terms"), analysis.nodes, query, limit)
        terminals = [r["id"] for r in analysis.nodes.join(hits, F.col("work_label") == hits["label"]).select("id").distinct().collect()]
        if not terminals:
            return A.Analysis(analysis.nodes.where(F.lit(False)), analysis.links.where(F.lit(False)))
        edges = analysis.links.select(F.col("source").alias("src"), F.col("target").alias("dst"), "weight")
        found = steiner.pseudo_steiner(analysis.nodes.select("id"), edges, terminals)
        return analysis.keep(found.vertices)

    def get_works(self, id: str, names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
        """(works in the order of the names, names that were not found); all works without names."""
        nodes = self.load_analysis(id).nodes
        if not names:
            return nodes, []
        if not nodes.take(1):
            return nodes, names
        targets = self.spark.createDataFrame(list(enumerate(names)), "pos int, target string")
        keyed = cut(nodes.withColumn("label", F.col("work_label")).withColumn("node", F.struct("work_label", "id")))
        found, missing = A.find_works(keyed, targets)
        left = [r["target"] for r in missing.orderBy("pos").collect()]  # at most the names asked for
        return keyed.join(found, "node").orderBy("pos").drop("node", "label", "pos"), left

    def preset(self, id: str, preset: str, limit: int = 20) -> DataFrame:
        """The works of an export preset in order, each once: tos (roots, trunk, leaves), roots,
        trunks, leaves or top_cited."""
        if preset not in PRESETS:
            raise ValueError(f"preset must be one of {PRESETS}")
        nodes = cut(self._nodes(id))
        if preset == "top_cited":
            return nodes.withColumn("_c", F.coalesce("times_cited", F.lit(0))).orderBy(F.desc("_c"), "work_label").limit(max(limit, 0)).drop("_c")
        wanted = {"tos": ["root", "trunk", "leaf"], "roots": ["root"], "trunks": ["trunk"], "leaves": ["leaf"]}[preset]
        parts = [A.top_by_category(nodes, c, limit).select("id", F.struct(F.lit(i).alias("list"), F.col("score").alias("s"), "work_label").alias("k"), F.lit(i).alias("list"), (-F.col("score")).alias("down")) for i, c in enumerate(wanted)]
        both = parts[0]
        for p in parts[1:]:
            both = both.union(p)
        first = both.groupBy("id").agg(F.min(F.struct("list", "down")).alias("k"))
        return nodes.join(first, "id").orderBy("k.list", "k.down", "work_label").drop("k")
