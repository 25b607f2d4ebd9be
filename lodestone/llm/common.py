"""Helpers that all corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where that is unset, a local session (tests, bench) has one of its own, and a cluster is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.conf.get("spark.app.id")
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return _local[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it back, so that a lost executor costs a read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a written() table which nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, *own: str) -> DataFrame:
    """An input column that has the name of a column the operator adds gives way to it."""
    return df.drop(*own)


def row_key(text: Column) -> Column:
    """64 bits of a text. With a row's id they find the row again: rows that share both are copies, but for one chance in 2**64 for two rows of one id."""
    return F.xxhash64(text)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def apart(df: DataFrame) -> DataFrame:
    """Cut a grouped table loose from its grouping, so that a join deals out both sides itself and adaptive execution can split a hot key."""
    return df.hint("rebalance")


def release(spark: SparkSession) -> None:
    """Let the context cleaner free the shuffle files of plans that are done with."""
    gc.collect()
    spark._jvm.System.gc()
