"""All queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canopy.plans import catalog, graph, integrity, service, works

MODULES = [works, graph, catalog, service, integrity]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return queries()["sap_categories"](spark, folder)
