"""Centroid clustering by tournaments of bisectors.

For each pair of centroids i < j the sign of ``x . 2(c_j - c_i) - (|c_j|^2 - |c_i|^2)`` says which of the two is nearer to x.
Normals and thresholds of all pairs are whole numbers, made once a round. Every vector plays a knockout: in each match the
sign eliminates one centroid, zero favours the smaller number, and after k - 1 matches the nearest is left. Its distance
is computed from the components. All arithmetic is that of 64-bit whole numbers, so nothing depends on the partitioning.

A round reads the vectors once; tasks return a sum for each centroid, and the driver holds k centroids.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written
from lodestone.llm.integers import below, finite, floored_means, matrix, whole

#: Centroids, rounds of assigning and averaging, components, and what a component is multiplied by.
CENTROIDS, ROUNDS, DIMENSIONS, SCALE = 40, 5, 64, 256
#: Components are below 2**BITS as whole numbers: 64 squares of their differences fit in 64 bits.
BITS = 27
#: Vectors that play their matches together.
TOGETHER = 2048


class Bisectors(NamedTuple):
    centroids: np.ndarray  # k x dimensions
    normals: np.ndarray  # k x k x dimensions; [i, j] points from i to j
    cuts: np.ndarray  # k x k

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each vector's nearest centroid, and the squared distance to it."""
        winners = np.empty(len(x), np.int64)
        for at in range(0, len(x), TOGETHER):
            part = x[at : at + TOGETHER]
            alive = [np.full(len(part), c) for c in range(len(self.centroids))]
            while len(alive) > 1:  # the left of two always has the smaller number
                left = [alive[-1]] if len(alive) % 2 else []
                alive = [self._match(part, a, b) for a, b in zip(alive[::2], alive[1::2], strict=False)] + left
            winners[at : at + TOGETHER] = alive[0]
        away = x - self.centroids[winners]
        return winners, (away * away).sum(axis=1)

    def _match(self, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        side = np.einsum("nd,nd->n", x, self.normals[a, b]) - self.cuts[a, b]
        return np.where(side > 0, b, a)


def bisectors(centroids: list[list[int]]) -> Bisectors:
    c = np.array(centroids, np.int64)
    squares = (c * c).sum(axis=1)
    return Bisectors(c, 2 * (c[None, :, :] - c[:, None, :]), squares[None, :] - squares[:, None])


class Clustering(NamedTuple):
    rows: DataFrame  # id, cluster, distance
    centroids: list[list[int]]


def first_centroids(rows: DataFrame, k: int) -> list[list[int]]:
    """The vectors whose ids have the least hashes; rows without an id are no centroids, ties go to the lesser vector."""
    named = rows.where("id is not null").withColumn("key", F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256))
    return [list(r["vec"]) for r in named.orderBy("key", "vec").limit(k).collect()]


def cluster(
    vectors: DataFrame, *, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMENSIONS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> Clustering:
    """Vectors of ``dims`` components by ``k`` centroids after ``rounds`` rounds.

    Vectors that are null, have another number of components or hold null or non-finite ones take no part, nor do those
    with a component of 2**27 or more after scaling, whose distances do not fit in 64 bits. Repeated rows and ids
    count and come out as often as they occur; a null id takes part but starts no centroid. With fewer rows than
    ``k`` each is a centroid. Equal centroids: the smaller number gets the vectors, the other stays as it is. Other
    columns, whatever their names, are not read. An empty table gives an empty one, without centroids.
    """
    col = F.col(vector_col)
    kept = vectors.where(finite(col) & (F.size(col) == dims)).where(below(col, scale, BITS))
    rows = written(kept.select(F.col(id_col).cast("long").alias("id"), whole(col, scale).alias("vec")), "cluster-vectors")
    centroids = first_centroids(rows, k)
    if not centroids:
        return Clustering(rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), [])
    for _ in range(rounds):
        means = floored_means(_sums(rows, bisectors(centroids)), ["cluster"], dims)
        centroids = [means.get((c,), old) for c, old in enumerate(centroids)]
    return Clustering(_assigned(rows, bisectors(centroids)), centroids)


def _sums(rows: DataFrame, field: Bisectors) -> DataFrame:
    """For each task the number and sum of each centroid's vectors."""
    k, dims = field.centroids.shape

    def run(batches):
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), dims)
            near, _ = field.nearest(x)
            n += np.bincount(near, minlength=k)
            np.add.at(sums, near, x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(n), pa.array(list(sums))], names=["cluster", "n", "sums"])

    return rows.select("vec").mapInArrow(run, "cluster int, n long, sums array<long>")


def _assigned(rows: DataFrame, field: Bisectors) -> DataFrame:
    dims = field.centroids.shape[1]

    def run(batches):
        for batch in batches:
            near, distance = field.nearest(matrix(batch.column(1), dims))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.int32()), pa.array(distance)], names=["id", "cluster", "distance"])

    return rows.select("id", "vec").mapInArrow(run, "id long, cluster int, distance long")


def reported(found: Clustering) -> DataFrame:
    """vec_id, cluster, distance, the inertia of the cluster and of all (null where 64 bits do not hold it), a digest of the centroid."""
    rows = written(found.rows, "cluster-assigned")
    spark = rows.sparkSession
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row for each centroid
    all_of = sum(int(r["s"]) for r in sums)
    fit = lambda v: v if v < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    about = [(r["cluster"], fit(int(r["s"])), fit(all_of), digest[r["cluster"]]) for r in sums]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.withColumnRenamed("id", "vec_id").join(F.broadcast(table), "cluster")  # at most k rows
