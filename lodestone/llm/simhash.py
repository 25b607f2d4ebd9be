"""SimHash near-dedup with BK-trees.

The 64 bits of a fingerprint are cut into four blocks. Fingerprints at distance two
or less agree in at least two whole blocks, so each goes to six shards, one for
each pair of blocks. A shard's fingerprints form a BK-tree, in which a
node's children are keyed by their distance to it, and a search follows only
the edges within the radius of the distance at hand. A shard reports its
links as stars, not as pairs.
"""

from __future__ import annotations

from itertools import combinations, islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import apart, row_key, text_or_empty, without, written
from lodestone.llm.components import components

WORDS, RADIUS, SEED = 3, 2, 42
#: Fingerprints in one tree. Larger shards, which near copies can make, are linked through their one-bit neighbours instead; that is exact too and needs no group in memory.
TREE = 4096
#: Bytes of a text, and shingles, worked on at a time.
BLOCK, MANY = 1 << 22, 1 << 16

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _words(raw: bytes):
    """Lists of words, block by block; blocks end at white space."""
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + BLOCK)
        while end < n and raw[end] not in b" \t\n\x0b\f\r":
            end += 1
        yield raw[at:end].lower().split()
        at = end


def _shingles(raw: bytes):
    """Whole text -> its word shingles."""
    rest, some = [], False
    for words in _words(raw):
        words = rest + words
        if len(words) >= WORDS:
            some = True
            yield from map(b" ".join, zip(*[words[i:] for i in range(WORDS)], strict=False))
        rest = words[-(WORDS - 1) :]
    if not some and rest:
        yield b" ".join(rest)


def fingerprint(raw: bytes) -> int:
    """64 bits, each 1 if it is set in over half the shingles' hashes."""
    from xxhash import xxh64_intdigest

    hashes = map(xxh64_intdigest, _shingles(raw), repeat(SEED))
    counts, n = np.zeros(64, np.int64), 0
    while len(h := np.fromiter(islice(hashes, MANY), np.uint64)):
        n += len(h)
        for i, column in enumerate(h.view(np.uint8).reshape(-1, 8).T):
            counts[8 * i : 8 * i + 8] += np.bincount(column, minlength=256) @ _BITS
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed long. A null or empty text has 0."""
    small = docs.select(*[f"`{c}`" for c in keep], docs[text_col].alias("_sim_text"))
    schema = T.StructType([*small.drop("_sim_text").schema, T.StructField("fp", T.LongType(), False)])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            prints = np.fromiter((fingerprint(x.as_py() or b"") for x in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints)], names=[*batch.schema.names[:-1], "fp"])

    return small.mapInArrow(run, schema)


class BKTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.prints: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, x: int, radius: int) -> list[int]:
        """Places of the nodes within the radius."""
        found, todo = [], [0] if self.prints else []
        while todo:
            at = todo.pop()
            d = (self.prints[at] ^ x).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.children[at]
            todo += [edges[k] for k in range(d - radius, d + radius + 1) if k in edges]
        return found

    def add(self, x: int) -> None:
        self.prints.append(x)
        self.children.append({})
        new, at = len(self.prints) - 1, 0
        while new:
            d = (self.prints[at] ^ x).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = new
                return
            at = self.children[at][d]


def linked(prints: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Stars that join what a BK-tree over these distinct fingerprints links."""
    tree, top = BKTree(), list(range(len(prints)))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, x in enumerate(prints):
        for j in tree.near(x, radius):
            a, b = root(i), root(j)
            top[max(a, b)] = min(a, b)
        tree.add(x)
    return [(prints[i], prints[root(i)]) for i in range(len(prints)) if root(i) != i]


def _shards(prints: DataFrame) -> DataFrame:
    """(fp) -> (fp, pair, blocks), six rows each."""
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [F.struct(F.lit(n).alias("pair"), F.shiftleft(block[i], 16).bitwiseOR(block[j]).alias("blocks")) for n, (i, j) in enumerate(combinations(range(4), 2))]
    return prints.select("fp", F.explode(F.array(*keys)).alias("s")).select("fp", "s.pair", "s.blocks")


def _tree_links(shards: DataFrame) -> DataFrame:
    """Links from the trees of shards, whose rows arrive together and in order."""

    def run(batches):
        key, held = None, []
        for pdf in batches:
            pair, blocks, fp = (pdf[c].to_numpy(np.int64) for c in ("pair", "blocks", "fp"))
            edge = np.flatnonzero((np.diff(pair) != 0) | (np.diff(blocks) != 0)) + 1
            out = []
            for a, b in zip([0, *edge], [*edge, len(fp)], strict=True):
                if a == b:
                    continue
                if (here := (pair[a], blocks[a])) != key:
                    out += linked(held) if len(held) > 1 else []
                    key, held = here, []
                held += fp[a:b].view(np.uint64).tolist()
            if out:
                yield pd.DataFrame(np.array(out, np.uint64).view(np.int64).reshape(-1, 2), columns=["a", "b"])
        if len(held) > 1 and (out := linked(held)):
            yield pd.DataFrame(np.array(out, np.uint64).view(np.int64).reshape(-1, 2), columns=["a", "b"])

    return shards.repartition("pair", "blocks").sortWithinPartitions("pair", "blocks", "fp").mapInPandas(run, "a long, b long")


def _neighbour_links(prints: DataFrame) -> DataFrame:
    """Links of fingerprints that are equal to, or one bit from, the same number: those at distance two or less."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    around = prints.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("hub"))
    least = around.groupBy("hub").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return around.join(apart(least), "hub").where("fp <> b").select(F.col("fp").alias("a"), "b")


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that join distinct fingerprints (fp) as far as links within the radius reach."""
    shards = _shards(prints)
    sizes = shards.groupBy("pair", "blocks").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = written(sizes, "simhash-shards")
    small = shards.join(sizes.where(F.col("n") <= TREE).select("pair", "blocks"), ["pair", "blocks"])
    large = shards.join(sizes.where(F.col("n") > TREE).select("pair", "blocks"), ["pair", "blocks"]).select("fp").distinct()
    return _tree_links(small).unionByName(_neighbour_links(large))


def _rooted(prints: DataFrame, *first) -> DataFrame:
    """Rows (fp, ...) -> (fp, root, and the aggregates ``first`` of the rows of each fp), one for each fingerprint."""
    distinct = written(prints.groupBy("fp").agg(*first), "simhash-distinct")
    stars = components(links(distinct.select("fp")))
    return distinct.join(stars, F.col("fp") == F.col("node"), "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id in its group.

    Documents without words have fingerprint zero and are linked like others. Null ids are kept but never name a group
    (a group of null ids alone has a null name). Repeated rows stay. An empty table gives an empty table.
    """
    prints = written(fingerprints(docs, text_col=text_col, keep=(id_col,)).withColumnRenamed(id_col, "_sim_id"), "simhash")
    rooted = _rooted(prints, F.min("_sim_id").alias("first"))
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(apart(names), "root").select(F.col("fp").alias("_fp"), "component_id")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, F.col("fp") == F.col("_fp")).select(F.col("_sim_id").alias(id_col), digits.alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents that stay: of each group one row, that with the smallest id, null ids last; of rows with that id the one whose text has the least hash.

    Of rows that share id and text any one stays. Null texts are empty; all texts without words are one group. Columns named
    fingerprint or component_id give way. An empty table gives an empty table.
    """
    docs = without(docs, "fingerprint", "component_id").withColumn("_sim_th", row_key(text_or_empty(text_col)))
    prints = written(fingerprints(docs, text_col=text_col, keep=(id_col, "_sim_th")).withColumnRenamed(id_col, "_sim_id"), "simhash")
    who = F.struct(F.col("_sim_id").isNull().alias("none"), F.col("_sim_id").alias("id"), F.col("_sim_th").alias("th"))
    rooted = _rooted(prints, F.min(who).alias("first"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("_sim_i"), F.col("first.th").alias("_sim_t"))
    one = lambda name: F.col(name).eqNullSafe(F.col("_sim_i")) & (F.col("_sim_th") == F.col("_sim_t"))
    counted = prints.join(apart(firsts), one("_sim_id")).groupBy("_sim_i", "_sim_t").agg(F.count(F.lit(1)).alias("_sim_n"))
    kept = docs.join(counted, one(id_col))
    once, more = kept.where("_sim_n = 1"), kept.where("_sim_n > 1").dropDuplicates([id_col, "_sim_th"])
    return once.unionByName(more).drop("_sim_th", "_sim_i", "_sim_t", "_sim_n")
