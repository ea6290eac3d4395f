"""All queries of the llm problems and their SQL."""

from __future__ import annotations

from canopy.llm import queries as main

MODULES = [main]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
