"""Exact top-k search by inner product, over buckets of vectors of like length.

Vectors become whole numbers and fall into cells of like length, a sixteenth of an octave of the square each; a cell with
many vectors is dealt out into buckets. Each query is held against the buckets of the longest vectors first; the k-th best
product found there is its floor. A bucket whose longest vector cannot reach the floor is left out for the query. In each other bucket the floor, divided by both lengths, is the local cosine threshold. From it
follow two ways to prune: by length, vectors too short for the floor go; by coordinates, a normed vector within the
threshold's angle of the query has each coordinate in an interval, and those outside the interval go. The one that leaves
fewer vectors is taken, and the products of those left are computed exactly.

Equal vectors form one class, which is looked at once, so a vector with a third of all rows costs what one row costs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import written
from lodestone.llm.integers import below, finite, whole

#: What components are multiplied by, classes in a bucket and queries in a block, on average.
SCALE, BUCKET, QUERIES = 256, 4096, 4096
#: Cells in an octave of squared lengths, and of squared floors: at most 62 times as many in all.
CELLS, REACHES = 16, 2
#: Coordinates of a query that are looked at, the local cosine from which they are, and the share of a bucket that they must leave at most.
FOCUS, COSINE, SHARE = 3, 0.5, 0.25
#: Roundings of lengths and angles stay below this.
SLACK = 1e-9
#: Queries whose products are computed at once.
_AT_ONCE = 128


def search(
    vectors: DataFrame, queries: Column, *, k: int = 5, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The k rows of largest inner product for each row that the condition ``queries`` holds for.

    Returns query_id, rank (from 1), vec_id, score: exact products of the whole numbers. Ties go to the smaller id; a row is
    not its own candidate, but its copies are. Vectors that are null or hold null or non-finite components take no part,
    nor do rows without an id and vectors whose squared length would not fit in 62 bits. A vector's candidates are
    those of its own dimension; repeated rows count once, an id with two vectors is both. A zero vector has product zero with
    all. Other columns, whatever their names, are not read. An empty table gives an empty table.
    """
    col = F.col(vector_col)
    ids = F.col(id_col).cast("long")
    length = F.aggregate(col, F.lit(0.0), lambda s, v: s + (v.cast("double") * scale) * (v.cast("double") * scale))
    sound = vectors.where(ids.isNotNull() & finite(col)).where(below(col, scale, 31) & (length < float(1 << 61)))
    rows = sound.select(ids.alias("id"), whole(col, scale).alias("vec"), F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = written(rows.distinct(), "norm-rows")
    # The k + 1 first rows of each class are all that a result can hold.
    first = Window.partitionBy("vec").orderBy("id")
    members = rows.select("vec", "id").distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    square = F.aggregate("vec", F.lit(0).cast("long"), lambda s, v: s + v * v)
    classes = members.groupBy("vec").agg(F.min("id").alias("cls"), F.sort_array(F.collect_list("id")).alias("ids"))
    classes = written(classes.withColumn("square", square).withColumn("cell", _octave(F.col("square"), CELLS)), "norm-classes")
    asked = rows.where("asked").select("id", "vec").join(classes.select("vec", "cls"), "vec")
    asked = written(asked.select("id", F.col("cls").alias("query")), "norm-asked")
    wanted = asked.select(F.col("query").alias("cls")).distinct().join(classes.select("cls", "vec", "square"), "cls")
    wanted = written(wanted.withColumnRenamed("cls", "query"), "norm-queries")
    best = written(_best(classes, wanted, k + 1), "norm-scores")
    top = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cls"))
    lists = best.withColumn("n", top).where(F.col("n") <= k + 1).join(classes.select("cls", F.explode("ids").alias("vec_id")), "cls")
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    lists = lists.withColumn("n", order).where(F.col("n") <= k + 1).select("query", "vec_id", "score")
    found = asked.join(lists, "query").where("vec_id <> id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("query_id"), "rank", "vec_id", "score")


def _octave(square: Column, each: int) -> Column:
    """The cell of a squared length; -1 of zero."""
    return F.when(square >= 1, F.floor(F.log2(square.cast("double")) * each)).otherwise(-1).cast("int")


def _part(key: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key), parts).cast("int")


def _dealt(df: DataFrame, cell: str, key: str, size: int, part: str) -> tuple[DataFrame, list[tuple[int, int, int, float]]]:
    """Adds the part of its cell that each row is dealt to, of about ``size`` rows; and for each cell, the highest first, its
    rows, parts and the largest value of the column ``bound``. There are as many cells as octaves allow, whatever the rows."""
    found = df.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.max("bound").alias("most"), F.min("bound").alias("least")).collect()
    cells = sorted(((r[cell], -(-r["n"] // size), r["n"], r["most"], r["least"]) for r in found), reverse=True)
    parts = df.sparkSession.createDataFrame([c[:2] for c in cells], f"{cell} int, _parts int")
    return df.join(F.broadcast(parts), cell).withColumn(part, _part(key, F.col("_parts"))).drop("_parts", "bound"), cells


def _best(classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(query, cls, score): at least the k best classes of each query."""
    small = classes.select("cell", "cls", "vec", "square", F.col("square").alias("bound"))
    small, cells = _dealt(small, "cell", "cls", BUCKET, "part")
    if not cells:
        return wanted.sparkSession.createDataFrame([], "query long, cls long, score long")
    # The longest vectors, about as many as a bucket holds.
    head, held = {}, 0
    for cell, parts, n, *_ in cells:
        head[cell] = min(parts, -(-(BUCKET - held) * parts // n)) if held < BUCKET else 0
        held += n * head[cell] // parts
    every = wanted.withColumns({"least": F.lit(None).cast("long"), "reach": F.lit(0), "bound": F.lit(0.0)})
    every, blocks = _dealt(every, "reach", "query", QUERIES, "qpart")
    begun = written(_met(small, every, [(r, q, c, 0, head[c]) for r, q, *_ in blocks for c, *_ in cells], k), "norm-first")
    # The k-th best product so far. Classes below it are not among the k best.
    least = begun.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    least = least.where(F.col("n") >= k).select("query", F.col("s")[k - 1].alias("least"))
    need = F.when(F.col("least") > 0, F.col("least").cast("double") * F.col("least") / F.col("square")).otherwise(0.0)
    floors = wanted.join(least, "query", "left").withColumn("bound", F.coalesce(need, F.lit(0.0)))
    # Queries of like needs stand together, so that a block leaves out what all of them leave out.
    floors, blocks = _dealt(floors.withColumn("reach", _octave(F.col("bound"), REACHES)), "reach", "query", QUERIES, "qpart")
    rest = [(r, q, c, head[c], p) for r, q, _, _, needed in blocks for c, p, _, top, _ in cells if top * (1 + SLACK) >= needed]
    return begun.unionByName(_met(small, written(floors, "norm-floors"), rest, k))


def _met(classes: DataFrame, wanted: DataFrame, pairs: list[tuple[int, int, int, int, int]], k: int) -> DataFrame:
    """The k best classes of a bucket for each query of a block. Pairs: a cell of queries and its blocks, a cell of classes and
    which of its buckets, from and to."""
    pairs = [p for p in pairs if p[3] < p[4]]
    plan = F.broadcast(wanted.sparkSession.createDataFrame(pairs, "reach int, _blocks int, cell int, _from int, _to int"))
    key = ("cell", "part", "reach", "qpart")
    left = classes.join(plan, "cell").where("part >= _from and part < _to").withColumn("qpart", F.explode(F.expr("sequence(0, _blocks - 1)")))
    right = wanted.join(plan, "reach").withColumn("part", F.explode(F.expr("sequence(_from, _to - 1)")))
    left, right = left.select(*key, "cls", "vec", "square"), right.select(*key, "query", "vec", "square", "least")
    shape = "query long, cls long, score long"

    def run(bucket: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 3), np.int64)]
        for d in set(bucket["vec"].map(len)) & set(queries["vec"].map(len)):
            out.append(_within(bucket[bucket["vec"].map(len) == d], queries[queries["vec"].map(len) == d], k))
        return pd.DataFrame(np.concatenate(out), columns=["query", "cls", "score"])

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, shape)


def products(q: np.ndarray, p: np.ndarray, longest: float) -> np.ndarray:
    """All inner products, exactly: as doubles while every sum stays below 2**53, as 64-bit whole numbers else."""
    if longest < 2.0**52:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    return q @ p.T


def _within(bucket: pd.DataFrame, queries: pd.DataFrame, k: int) -> np.ndarray:
    """Rows of (query, class, product) of one bucket and a block of queries of one dimension."""
    bucket = bucket.sort_values(["square", "cls"], ascending=[False, True])
    p, names = np.array(bucket["vec"].to_list(), np.int64).reshape(len(bucket), -1), bucket["cls"].to_numpy(np.int64)
    q, asked = np.array(queries["vec"].to_list(), np.int64).reshape(len(queries), -1), queries["query"].to_numpy(np.int64)
    lengths, own = np.sqrt(bucket["square"].to_numpy(np.float64)), np.sqrt(queries["square"].to_numpy(np.float64))
    floor = queries["least"].astype("Int64").fillna(np.iinfo(np.int64).min).to_numpy(np.int64)
    positive = (floor > 0) & (own > 0)
    cosine = np.full(len(q), -1.0)
    cosine[positive] = floor[positive] / (own[positive] * max(lengths[0], 1e-300)) * (1 - SLACK)
    # By length: how many vectors, the longest first, can reach the floor.
    shortest = np.where(positive, floor / np.where(own > 0, own, 1.0) * (1 - SLACK), -1.0)
    long_enough = np.searchsorted(-lengths, -shortest, side="right")
    longest = float(lengths[0] * own.max(initial=0.0))
    out, left = [], []
    sides = _Coordinates(p, lengths) if (cosine >= COSINE).any() else None
    for i in np.flatnonzero(long_enough > 0):
        some = sides.within(q[i] / own[i], cosine[i], long_enough[i]) if sides and cosine[i] >= COSINE else None
        if some is None:
            left.append(i)
        else:
            out.append(_top(asked[i : i + 1], names[some], products(q[i : i + 1], p[some], longest), floor[i : i + 1], k))
    left = np.array(left, np.int64)[np.argsort(long_enough[left], kind="stable")] if left else np.zeros(0, np.int64)
    for at in range(0, len(left), _AT_ONCE):
        i = left[at : at + _AT_ONCE]
        n = int(long_enough[i].max())
        out.append(_top(asked[i], names[:n], products(q[i], p[:n], longest), floor[i], k))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


class _Coordinates:
    """The normed vectors of a bucket, in the order of each coordinate."""

    def __init__(self, p: np.ndarray, lengths: np.ndarray):
        self.normed = p / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.order = np.argsort(self.normed, axis=0)
        self.sorted = np.take_along_axis(self.normed, self.order, axis=0)

    def within(self, query: np.ndarray, cosine: float, longest: int) -> np.ndarray | None:
        """Places of the vectors whose coordinates allow the cosine; None where that would leave too many of the ``longest``."""
        focus = np.argsort(-np.abs(query), kind="stable")[:FOCUS]
        mine, angle = np.arccos(np.clip(query[focus], -1, 1)), np.arccos(min(1.0, cosine))
        low = np.cos(np.minimum(np.pi, mine + angle)) - SLACK
        high = np.cos(np.maximum(0.0, mine - angle)) + SLACK
        starts = [np.searchsorted(self.sorted[:, f], a, side="left") for f, a in zip(focus, low, strict=True)]
        ends = [np.searchsorted(self.sorted[:, f], b, side="right") for f, b in zip(focus, high, strict=True)]
        sizes = np.subtract(ends, starts)
        best = int(sizes.argmin())
        if sizes[best] > SHARE * longest:
            return None
        some = self.order[starts[best] : ends[best], focus[best]]
        some = some[some < longest]
        near = self.normed[np.ix_(some, focus)]
        return some[((near >= low) & (near <= high)).all(axis=1)]


def _top(asked: np.ndarray, names: np.ndarray, scores: np.ndarray, floor: np.ndarray, k: int) -> np.ndarray:
    """The k best of each row of scores that reach its floor, ties to the smaller name."""
    n = scores.shape[1]
    least = np.maximum(np.partition(scores, n - k, axis=1)[:, n - k], floor) if n > k else floor
    row, at = np.nonzero(scores >= least[:, None])
    order = np.lexsort((names[at], -scores[row, at], row))
    row, at = row[order], at[order]
    sizes = np.bincount(row, minlength=len(asked))
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, at = row[place < k], at[place < k]
    return np.stack([asked[row], names[at], scores[row, at]], axis=1)
