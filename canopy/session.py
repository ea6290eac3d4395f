"""Session helpers: building a session, cutting lineage, reading tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "canopy", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew joins and UTC time; `conf` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.

    A cluster names it in `spark.checkpoint.dir`. Only a local session, whose executors
    are the driver, may fall back to a temporary folder of this machine.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        where = tempfile.mkdtemp(prefix="canopy-checkpoints-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
    sc.setCheckpointDir(where)
    return where


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Takes effect for functions made afterwards; where executors have the package elsewhere
    on their path, the extra entry changes nothing.
    """
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and read it back: lineage ends, executors may be lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_by(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """As cut(), in `parts` partitions by the keys and ordered by them within one; joins and
    groupings by these keys then shuffle only what meets the rows, not the rows again."""
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    # What adaptive execution plans isn't known to be partitioned once it is read back.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(parts, *keys).sortWithinPartitions(*keys))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder (one file or a folder of files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
