"""Sinks: histories, snapshots and the metrics of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.ingest import run_status
from lodestone.sources.ledger import Ledger


def append(df: DataFrame, path: str, *by: str) -> None:
    """Add rows to a history, in folders by the columns."""
    (df.write.partitionBy(*by) if by else df.write).mode("append").parquet(path)


class Snapshots:
    """A table of which the last version counts, by its number in a ledger."""

    def __init__(self, spark: SparkSession, path: str):
        self._ledger = Ledger(spark, path)

    def write(self, df: DataFrame) -> int:
        return self._ledger.write(df)

    def read(self) -> DataFrame:
        return self._ledger.read()


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The frame with counters that are filled as it is written: processed, rejected, created, price_changes."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("processed"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"), F.count_if(F.col("change") == "created").alias("created"), F.count_if(F.col("change") == "price_changed").alias("price_changes")), seen


def record_run(spark: SparkSession, path: str, source: str, metrics: dict) -> None:
    """One row for a run, with the status that its counters amount to."""
    row = spark.createDataFrame([(source, metrics["processed"], metrics["rejected"], metrics["created"], metrics["price_changes"])], "source string, processed long, rejected long, created long, price_changes long")
    row.withColumn("status", run_status(F.col("rejected"), F.col("processed") - F.col("rejected"))).write.mode("append").parquet(path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))
