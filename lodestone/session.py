"""The Spark session that the engine is meant for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lodestone", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skewed joins split; whatever the cluster has set already stays."""
    builder = SparkSession.builder.appName(name)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for k, v in {**base, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
