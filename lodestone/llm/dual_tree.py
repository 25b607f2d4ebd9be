"""Vector code compression by dual-tree Lloyd rounds.

Vectors are cut into equal parts, and each part position has a codebook. A block of vectors is stored with one tree
for each position over its parts: the order in which halving puts them. A round also makes a tree over each
codebook's entries. Both trees are walked together: a pair of nodes whose boxes lie farther apart than some
other entry's box can be away from any part of the node is dropped, exactly. Where one entry is left, the node goes to
it as a whole, by its cached sum and count; leaves that stay uncertain compare whole numbers with the entries left.

Tasks return a sum for each entry; the driver holds the codebooks.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import apart, written
from lodestone.llm.integers import below, finite, floored_means, matrix, whole

#: Parts of a vector, entries of a codebook, rounds, and what a component is multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components are below 2**BITS as whole numbers, so that the error of 256 of them fits in 64 bits.
BITS = 26
#: Vectors in a block, and parts in a leaf of its trees.
BLOCK, LEAF = 2048, 16
_FAR = np.iinfo(np.int64).max


def halved(x: np.ndarray, depth: int) -> np.ndarray:
    """An order of the rows in which node i of level l is the range from n * i // 2**l, by halving along the widest side."""
    n, order = len(x), np.arange(len(x))
    for level in range(depth):
        cuts = n * np.arange((2 << level) + 1) // (2 << level)
        for a, mid, b in zip(cuts[:-1:2], cuts[1::2], cuts[2::2], strict=True):
            if a < mid < b:
                own = order[a:b]
                part = x[own]
                side = part[:, (part.max(axis=0) - part.min(axis=0)).argmax()]
                order[a:b] = own[np.argpartition(side, mid - a)]
    return order


class Tree(NamedTuple):
    """Boxes, counts and sums of the nodes of each level; level l has 2**l nodes, some of which may be empty."""

    points: np.ndarray  # in the tree's order
    low: list[np.ndarray]
    high: list[np.ndarray]
    count: list[np.ndarray]
    total: list[np.ndarray]

    def range(self, level: int, node: int) -> slice:
        n = len(self.points)
        return slice(n * node >> level, n * (node + 1) >> level)


def tree(points: np.ndarray, depth: int) -> Tree:
    """The tree over points that stand in the order of halved()."""
    n, d = points.shape
    cuts = n * np.arange((1 << depth) + 1) >> depth
    count = np.diff(cuts)
    low, high = np.full((1 << depth, d), _FAR >> 34), np.full((1 << depth, d), -(_FAR >> 34))
    total = np.zeros((1 << depth, d), np.int64)
    some = count > 0
    if some.any():
        starts = cuts[:-1][some]
        low[some], high[some] = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)
        total[some] = np.add.reduceat(points, starts)
    levels = [(low, high, count, total)]
    for _ in range(depth):
        low, high, count, total = levels[0]
        up = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), count[::2] + count[1::2], total[::2] + total[1::2]
        levels.insert(0, up)
    return Tree(points, *(list(x) for x in zip(*levels, strict=True)))


class Book(NamedTuple):
    """A codebook and the tree over its entries, down to single ones."""

    entries: np.ndarray
    order: np.ndarray
    tree: Tree
    depth: int


def book(entries: np.ndarray) -> Book:
    depth = (len(entries) - 1).bit_length()
    order = halved(entries, depth)
    return Book(entries, order, tree(entries[order], depth), depth)


class Assignment(NamedTuple):
    whole: list[tuple[int, int, int]]  # level, node, entry
    leaves: list[tuple[int, np.ndarray]]  # leaf, the entries of its parts


def assign(data: Tree, depth: int, by: Book) -> Assignment:
    """Every part's nearest entry, ties to the lower number: whole nodes where one entry is left, leaves by their numbers else."""
    nodes, others = np.zeros(1, np.int64), np.zeros(1, np.int64)
    level = down = 0
    bound = np.full(1, _FAR)
    whole_nodes: list[tuple[int, int, int]] = []
    while True:
        low, high = data.low[level][nodes], data.high[level][nodes]
        low_e, high_e = by.tree.low[down][others], by.tree.high[down][others]
        gap = np.maximum(np.maximum(low_e - high, low - high_e), 0)
        span = np.maximum(high - low_e, high_e - low)
        near, far = (gap * gap).sum(axis=1), (span * span).sum(axis=1)
        np.minimum.at(bound, nodes, far)
        keep = near <= bound[nodes]
        nodes, others = nodes[keep], others[keep]
        if down == by.depth:
            alone = np.bincount(nodes, minlength=1 << level)[nodes] == 1
            entry = by.order[_place(by, others)]
            whole_nodes += [(level, int(a), int(e)) for a, e in zip(nodes[alone], entry[alone], strict=True)]
            nodes, others, entry = nodes[~alone], others[~alone], entry[~alone]
            if level == depth or not len(nodes):
                return Assignment(whole_nodes, _by_numbers(data, level, nodes, entry, by.entries))
        if level < depth:
            bound = np.repeat(bound, 2)
            nodes, others = np.concatenate([2 * nodes, 2 * nodes + 1]), np.concatenate([others, others])
            level += 1
        for _ in range(min(2, by.depth - down)):
            nodes, others = np.concatenate([nodes, nodes]), np.concatenate([2 * others, 2 * others + 1])
            down += 1
        some = by.tree.count[down][others] > 0
        nodes, others = nodes[some], others[some]


def _place(by: Book, single: np.ndarray) -> np.ndarray:
    return len(by.entries) * single >> by.depth


def _by_numbers(data: Tree, level: int, nodes: np.ndarray, entry: np.ndarray, entries: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.lexsort((entry, nodes))
    nodes, entry = nodes[order], entry[order]
    starts = np.flatnonzero(np.diff(nodes, prepend=-1))
    out = []
    for a, b in zip(starts, np.append(starts, len(nodes))[1:], strict=True):
        x, left = data.points[data.range(level, int(nodes[a]))], entries[entry[a:b]]
        distance = (left * left).sum(axis=1) - 2 * (x @ left.T)  # less the part's own square
        out.append((int(nodes[a]), entry[a:b][distance.argmin(axis=1)]))
    return out


def _depth(n: int) -> int:
    return max(0, (n - 1) // LEAF).bit_length()


class Codes(NamedTuple):
    rows: DataFrame  # the kept columns, code, error
    codebooks: list[list[list[int]]]  # parts x entries x components


def compress(
    vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = ("vec_id", "label"),
) -> Codes:
    """The columns ``keep``, ``code`` (two hex digits a part) and ``error`` (squared distance to what the code stands for).

    Vectors that are null or hold null or non-finite components take no part, nor do those of another dimension than most
    rows (of equal ones the larger), those that cannot be cut equally, and those with a component of 2**26 or more after
    scaling. The codebooks start with the vectors of the least ids (null ids last, ties to the lesser vector); with fewer
    rows than ``entries`` there are as many entries as rows. Repeated rows stay. Other columns are not read; ``code`` and
    ``error`` cannot be kept under these names. An empty table gives an empty one, without codebooks.
    """
    col = F.col(vector_col)
    sound = vectors.where(finite(col)).where(below(col, scale, BITS) & (F.size(col) % parts == 0) & (F.size(col) > 0))
    own = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    kept = sound.select(F.col(id_col).alias("id"), own, whole(col, scale).alias("vec"))
    sizes = kept.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "d")).alias("m"))
    most = sizes.first()["m"]
    kind = kept.schema["row"].dataType
    if most is None:
        none = T.StructType([*kind, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
        return Codes(vectors.sparkSession.createDataFrame([], none), [])
    dims = most["d"]
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries")
    kept = kept.where(F.size("vec") == dims)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    books = np.array([r["vec"] for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    blocks = written(_blocks(kept, parts, dims, kind), "code-blocks")
    for _ in range(rounds):
        means = floored_means(_sums(blocks, books), ["part", "entry"], dims // parts)
        books = np.array([[means.get((p, e), list(old)) for e, old in enumerate(b)] for p, b in enumerate(books)], np.int64)
    return Codes(_coded(blocks, books, kind).select("row.*", "code", "error"), books.tolist())


def _blocks(kept: DataFrame, parts: int, dims: int, kind: T.StructType) -> DataFrame:
    """Rows of up to BLOCK vectors: their kept columns, their numbers, and for each part position the order of its tree."""
    schema = T.StructType([T.StructField("rows", T.ArrayType(kind)), T.StructField("vectors", T.BinaryType()), T.StructField("orders", T.BinaryType())])

    def run(batches):
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, BLOCK):
                batch = whole_batch.slice(at, BLOCK)
                n = batch.num_rows
                x = matrix(batch.column(1), dims)
                orders = [halved(p, _depth(n)) for p in x.reshape(n, parts, -1).transpose(1, 0, 2)]
                rows = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(0))
                data = [pa.array([a.astype(np.int32).tobytes()], pa.binary()) for a in (x, np.stack(orders))]
                yield pa.RecordBatch.from_arrays([rows, *data], names=schema.names)

    return kept.select("row", "vec").mapInArrow(run, schema)


def _trees(batch: pa.RecordBatch, i: int, books: np.ndarray):
    """(order, tree, depth) of each part position of a block."""
    parts, _, d = books.shape
    x = np.frombuffer(batch.column("vectors")[i].as_py(), np.int32).reshape(-1, parts, d).astype(np.int64)
    orders = np.frombuffer(batch.column("orders")[i].as_py(), np.int32).reshape(parts, -1)
    depth = _depth(len(x))
    return [(orders[p], tree(x[orders[p], p], depth), depth) for p in range(parts)]


def _sums(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """For each task the number and sum of each entry's parts."""
    parts, k, d = books.shape

    def run(batches):
        own = [book(b) for b in books]
        n, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, d), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                for p, (_, data, depth) in enumerate(_trees(batch, i, books)):
                    found = assign(data, depth, own[p])
                    for level, node, e in found.whole:
                        n[p, e] += data.count[level][node]
                        sums[p, e] += data.total[level][node]
                    for leaf, chosen in found.leaves:
                        n[p] += np.bincount(chosen, minlength=k)
                        np.add.at(sums[p], chosen, data.points[data.range(depth, leaf)])
        part, entry = np.divmod(np.arange(parts * k, dtype=np.int32), k)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n.ravel()), pa.array(list(sums.reshape(-1, d)))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

    return blocks.select("vectors", "orders").mapInArrow(run, "part int, entry int, n long, sums array<long>")


def _coded(blocks: DataFrame, books: np.ndarray, kind: T.StructType) -> DataFrame:
    parts = len(books)
    schema = T.StructType([T.StructField("row", kind), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches):
        own = [book(b) for b in books]
        for batch in batches:
            for i in range(batch.num_rows):
                rows = batch.column("rows").slice(i, 1).flatten()
                codes, error = np.empty((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
                for p, (order, data, depth) in enumerate(_trees(batch, i, books)):
                    found, chosen = assign(data, depth, own[p]), np.empty(len(rows), np.int64)
                    for level, node, e in found.whole:
                        chosen[data.range(level, node)] = e
                    for leaf, some in found.leaves:
                        chosen[data.range(depth, leaf)] = some
                    away = data.points - books[p][chosen]
                    codes[order, p] = chosen
                    error[order] += (away * away).sum(axis=1)
                text = [c.tobytes().hex() for c in codes]
                yield pa.RecordBatch.from_arrays([rows, pa.array(text, pa.string()), pa.array(error)], names=schema.names)

    return blocks.mapInArrow(run, schema)


def reported(found: Codes) -> DataFrame:
    """The kept columns vec_id and label with code, error, the error of all rows of the label, and a digest of the codebooks."""
    digest = hashlib.sha256(",".join(str(v) for b in found.codebooks for e in b for v in e).encode()).hexdigest()
    rows = written(found.rows, "codes")
    sums = written(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    named = rows.join(apart(sums), F.col("label").eqNullSafe(F.col("_label")))
    return named.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
