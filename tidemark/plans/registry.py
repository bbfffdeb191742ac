"""Query registry: one Spark builder and (where SQL can say it) one DuckDB oracle per key.

Builders take ``(spark, sf_dir)`` and return a lazy DataFrame over the driver
tables. Oracles are ANSI SQL over the pre-registered views; fixtures are inlined
as CTEs (``tidemark.plans.oracle_fixtures``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.oracle_fixtures import with_fixtures

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, fixtures: tuple[str, ...] = ()):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_fixtures(sql, *fixtures)
        return fn

    return deco


def load_all() -> None:
    # Importing the modules registers their queries.
    from tidemark.plans import (  # noqa: F401
        q_columns,
        q_docs,
        q_monitor,
        q_profile,
        q_quality,
        q_recon,
        q_schema,
        q_sources,
        q_streams,
        q_tables,
        q_widgets,
    )
