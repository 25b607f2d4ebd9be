"""Vectors as whole numbers, and exact floors of their means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(col: Column, scale: int) -> Column:
    """Each component x, as double, becomes floor(scale * x)."""
    return F.transform(col, lambda v: F.floor(v.cast("double") * float(scale)).cast("long"))


def finite(col: Column) -> Column:
    """Not null, and without null or non-finite components."""
    sound = F.forall(col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return col.isNotNull() & F.coalesce(sound, F.lit(False))


def below(col: Column, scale: int, bits: int) -> Column:
    """All components are below 2**bits once they are whole numbers, so that what is computed from them fits in 64 bits."""
    return F.forall(col, lambda v: F.abs(v.cast("double") * float(scale)) < float(1 << bits))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of ``dims`` whole numbers each, without a copy of each list."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), dims)


def floored_means(partial: DataFrame, keys: list[str], dims: int) -> dict[tuple, list[int]]:
    """Partial sums (keys, n, sums) of tasks -> the floor of each key's mean, exactly.

    There are as many keys as centroids, whatever the number of rows.
    """
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    rows = partial.groupBy(*keys).agg(F.sum("n").alias("n"), *sums).where("n > 0").collect()
    return {tuple(r[k] for k in keys): [int(r[f"s{i}"]) // r["n"] for i in range(dims)] for r in rows}
