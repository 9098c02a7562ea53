"""All queries of the library by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradeloom.plans import domain, library, ordering, submissions, texts

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (submissions, texts, ordering, domain, library)


def queries() -> dict[str, Query]:
    return {name: query for module in _MODULES for name, query in module.REGISTRY.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.REGISTRY.oracles.items()}
