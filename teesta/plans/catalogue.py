"""All registered queries outside the text subpackage, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from teesta.plans import audits, found, panels, relational, statistics, texts, views, workflow

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (found, relational, panels, statistics, texts, audits, views, workflow)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.ORACLE
    return out
