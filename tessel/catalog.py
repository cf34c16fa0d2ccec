"""All queries of the library but those of ``llm``, with their DuckDB SQL.

Each module of ``plans`` registers its queries with ``query``; the SQL is what DuckDB runs on
the same tables. Those that SQL can't express have none and are tested in ``tests``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessel.shared import shipped

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    from tessel.plans import documents, media, raster, relational, scalar, sequence, stream  # noqa: F401


def queries() -> dict[str, Query]:
    load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    load()
    return ORACLES
