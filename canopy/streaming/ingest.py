"""Extension: keeping stored works up to date from a stream of raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from canopy.operators.dedup import one_per_key
from canopy.schema import RAW
from canopy.sources.store import Store
from canopy.sources.works import to_works


def read_stream(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Raw records as they arrive in a folder."""
    return spark.readStream.schema(RAW).format(format).load(path)


def ingest(raw: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Upsert every micro-batch into the stored works.

    Upserting a batch again gives the same works, so a batch that is repeated after a
    failure changes nothing. Of records with one id in a batch the one that compares
    greatest is taken.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        store.upsert(one_per_key(to_works(batch).where("label is not null"), "label"))
        store.commit()

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
