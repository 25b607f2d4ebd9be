"""All queries of the engine with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name, with SQL where SQL can say the same."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


from lodestone.plans import advice, browse, catalog, claims, dialog, documents, entities, hardware, identity, knowledge, market, prices, quality, sources, streams, upkeep  # noqa: E402, F401
