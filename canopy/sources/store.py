"""Stored collections, works, nodes and links as parquet behind one manifest.

Tables are written to new folders and become visible together when the manifest that
names them replaces the last one, so a reader sees a whole change or nothing of it. nodes
and links have a folder per collection: reading, replacing or dropping one collection
touches no other. works and the index terms of their texts have a folder per bucket of
labels: an upsert touches the buckets of its labels only. Paths go through Hadoop's file systems, so a shared store works.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators.search import indexed
from canopy.schema import TABLES, WORK_COLUMNS
from canopy.session import cut

SCHEMA_VERSION = 6
#: Tables that are stored in parts: nodes and links by collection, works and their index
#: terms by a bucket of the label.
BY_COLLECTION, BY_LABEL = ("nodes", "links"), ("works", "terms")
#: Parameters: buckets of labels, and the seconds for which folders that no manifest names
#: are kept, for readers that still follow an older one.
BUCKETS, KEPT = 64, 86_400


class StoreChanged(RuntimeError):
    """Another writer committed since this store read its manifest."""


def _from_5(manifest: dict) -> dict:
    """Version 6 has a serial number, retired folders, and works and terms in parts."""
    whole = manifest["tables"].pop("works", None)
    parts = manifest["parts"] | {t: {} for t in BY_LABEL}
    if whole:
        parts["works"] = {"all": whole}
    return manifest | {"version": 6, "parts": parts, "serial": 0, "retired": []}


#: What brings a manifest of a version to the next one.
MIGRATIONS = {5: _from_5}


class Store:
    """A warehouse folder. Changes are staged with put() and become visible with commit()."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = self._path("manifest.json")
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(""))
        self.manifest = self._current()
        self.next = json.loads(json.dumps(self.manifest))

    def _current(self) -> dict:
        """The manifest as it lies in the folder, brought to this version."""
        path = self._path("manifest.json")
        if not self.fs.exists(path):
            return {"version": SCHEMA_VERSION, "serial": 0, "tables": {}, "parts": {t: {} for t in BY_COLLECTION + BY_LABEL}, "retired": []}
        manifest = json.loads(self._read(path))
        while manifest["version"] in MIGRATIONS:
            manifest = MIGRATIONS[manifest["version"]](manifest)
        if manifest["version"] != SCHEMA_VERSION:
            raise ValueError(f"store has schema version {manifest['version']}, not {SCHEMA_VERSION}")
        return manifest

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _read(self, path) -> str:
        stream = self.fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], TABLES[table])

    def table(self, name: str, collection: str | None = None, staged: bool = False) -> DataFrame:
        """A table, or one collection's part of it; empty if nothing is stored."""
        m = self.next if staged else self.manifest
        if name in BY_COLLECTION + BY_LABEL:
            parts = m["parts"][name]
            paths = [parts[collection]] if collection in parts else [] if collection is not None else list(parts.values())
        else:
            paths = [p for p in [m["tables"].get(name)] if p]
        return self._rows(name, paths)

    def _rows(self, name: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(*[f"{self.root}/{p}" for p in paths]) if paths else self.empty(name)

    def put(self, name: str, rows: DataFrame, collection: str | None = None) -> None:
        """Write rows as the next version of a table, or of one collection's part of nodes or links.

        works come with their index terms. nodes or links without a collection replace the
        parts of all collections that stand in the rows.
        """
        if name in BY_LABEL:
            self.next["parts"]["works"], self.next["parts"]["terms"] = {}, {}
            self._put_works(rows)
        elif name in BY_COLLECTION and collection is None:
            self.next["parts"][name] |= self._parts(name, rows, F.col("collection_id"))
        else:
            folder = f"{name}/{uuid.uuid4().hex}"
            rows.select(*_columns(name)).write.parquet(f"{self.root}/{folder}")
            if name in BY_COLLECTION:
                self.next["parts"][name][collection] = folder
            else:
                self.next["tables"][name] = folder

    def _parts(self, name: str, rows: DataFrame, part: Column) -> dict[str, str]:
        """Write rows in one job into a folder for each value of `part`; {value: folder}."""
        folder = f"{name}/{uuid.uuid4().hex}"
        keyed = rows.select(*_columns(name), part.cast("string").alias("_part")).where("_part is not null")
        keyed.repartition("_part", F.pmod(F.monotonically_increasing_id(), F.lit(4))).write.partitionBy("_part").parquet(f"{self.root}/{folder}")
        unescaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(folder)) if s.isDirectory()]
        return {unescaped(n[len("_part=") :]): f"{folder}/{n}" for n in names if n.startswith("_part=")}

    def _put_works(self, works: DataFrame) -> None:
        bucket = F.pmod(F.xxhash64("label"), F.lit(BUCKETS))
        self.next["parts"]["works"] |= self._parts("works", works.where("label is not null"), bucket)
        self.next["parts"]["terms"] |= self._parts("terms", indexed(works.where("label is not null"), "label"), bucket)

    def upsert(self, new: DataFrame) -> None:
        """Upsert works (unique by label) into the staged ones: only the buckets of their labels are
        read and written, and index terms are made for these only."""
        new = cut(new.select(*WORK_COLUMNS))
        staged = self.next["parts"]["works"]
        # At most BUCKETS values.
        touched = [str(r["b"]) for r in new.where("label is not null").select(F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).alias("b")).distinct().collect()]
        if "all" in staged:  # a migrated store comes in buckets with its first change
            old = self._rows("works", list(staged.values()))
            self.next["parts"]["works"], self.next["parts"]["terms"] = {}, {}
        else:
            old = self._rows("works", [staged[b] for b in touched if b in staged])
        self._put_works(cut(upsert_works(old, new)))

    def drop(self, collection: str) -> None:
        """Forget a collection's nodes and links; works stay."""
        for t in BY_COLLECTION:
            self.next["parts"][t].pop(collection, None)

    def commit(self) -> None:
        """Make everything staged visible at once.

        Folders that the manifest no longer names are kept for KEPT seconds. Raises
        StoreChanged, with nothing changed, if the manifest isn't the one that was read.
        """
        if self._current()["serial"] != self.manifest["serial"]:
            raise StoreChanged("the store was changed by another writer")
        live, now = _folders(self.next), time.time()
        retired = [*self.manifest["retired"], *[[p, now] for p in sorted(_folders(self.manifest) - live)]]
        gone = [p for p, at in retired if at + KEPT <= now]
        self.next |= {"serial": self.manifest["serial"] + 1, "retired": [[p, at] for p, at in retired if at + KEPT > now]}
        target, fresh = self._path("manifest.json"), self._path(f"manifest-{uuid.uuid4().hex}")
        out = self.fs.create(fresh)
        out.write(bytearray(json.dumps(self.next).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, target, overwrite)
        self.manifest, self.next = self.next, json.loads(json.dumps(self.next))
        for p in gone:
            self.fs.delete(self._path(p), True)

    def rollback(self) -> None:
        self.next = json.loads(json.dumps(self.manifest))


def _columns(name: str) -> list[str]:
    return [c.split()[0] for c in TABLES[name].split(", ")]


def _folders(manifest: dict) -> set[str]:
    return {*manifest["tables"].values(), *(p for parts in manifest["parts"].values() for p in parts.values())}


def upsert_works(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Works by label: a new value that isn't null replaces the stored one, rich is either's.

    `new` may hold a label once only. An empty abstract is a value and replaces one.
    """
    old, fresh = stored.alias("o"), new.alias("n")
    value = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
    rich = (F.coalesce("n.rich", F.lit(False)) | F.coalesce("o.rich", F.lit(False))).alias("rich")
    return old.join(fresh, F.col("o.label") == F.col("n.label"), "full").select(*[rich if c == "rich" else value(c) for c in WORK_COLUMNS])
