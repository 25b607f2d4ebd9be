"""Substring dedup by MinHash banding of paragraphs.

A paragraph is a line of at least MIN_WORDS words. Consecutive lines of under SHORT words, up to a blank or longer line,
are a block, which is a unit like a paragraph and beside those in it, so that wrapped text, lists and verse are
compared as a whole. A document of under five words is a block too, with its whole word sequence as its only shingle. Units of the same words (A-Z in
lower case, white space aside) are one. Each different one gets a MinHash signature of its
five-word shingles, cut into bands; paragraphs that collide in a band are compared by
exact Jaccard similarity, links are joined to components, and of each component the
first paragraph stays while the others are cut out of their documents.

A passage may also stand inside a longer line that resembles no other. Stretches of
PASSAGE words are therefore units as well. They begin at the least of each GAP
neighbouring shingles, so any two copies of PASSAGE + GAP - 1 words or more hold the same ones.
They are joined by equality; the first document that has one keeps it.

The bands are tuned to miss at most one in 150 pairs at the threshold itself: with ten bands of
four rows a pair of similarity 0.8 collides with probability 0.995, one of 0.9 with 0.99997.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import apart, release, remove, row_key, text_or_empty, written
from lodestone.llm.components import components
from lodestone.llm.prefix_free import BASE, DOWN, UP, least_of, mix, prefix_sums, segments

WORDS, SIMILAR, MIN_WORDS, SHORT = 5, 0.8, 5, 20
BANDS, ROWS = 10, 4
#: Members of a bucket that are compared in one task. A larger one is dealt into cells, which first compare their own members and the PIVOTS
#: members that all cells share; what is then still in different components is compared cell by cell.
EXACT, PIVOTS = 512, 16
#: Words of a stretch, and shingles of which one begins a stretch; bytes by which the parts of a very long text overlap.
PASSAGE, GAP, LAP = 30, 21, 1 << 13
#: Shingles that are signed together, about; bytes that are hashed together.
BLOCK, PIECE = 1 << 16, 1 << 16

_U = np.uint64
_rng = np.random.default_rng(11)
_A = _rng.integers(0, 2**63, BANDS * ROWS, dtype=_U) * _U(2) + _U(1)
_C = _rng.integers(0, 2**64, BANDS * ROWS, dtype=_U)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class Words(NamedTuple):
    """The words of texts that lie one after another: where each begins and ends, in bytes, its hash, and the hash of it and the next ones as a shingle."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    shingle: np.ndarray


def words_of(data: np.ndarray, edges: np.ndarray) -> Words:
    """Words of the texts between neighbouring ``edges``; A-Z count as a-z. A word's hash follows from its bytes alone, whatever its length."""
    gap, edge = _GAP[data], np.zeros(len(data) + 1, bool)
    edge[edges] = True
    start = np.flatnonzero(~gap & (edge[:-1] | np.concatenate([[True], gap[:-1]])[: len(data)]))
    end = np.flatnonzero(~gap & (edge[1:] | np.concatenate([gap[1:], [True]])[: len(data)])) + 1
    first, last, down = (np.empty(len(start), _U) for _ in range(3))
    total = np.zeros(1, _U)
    for at in range(0, len(data), PIECE):
        s = prefix_sums(_LOW[data[at : at + PIECE]])
        up, back = (np.array([pow(base, at, 2**64)], _U) for base in (BASE, pow(BASE, -1, 2**64)))
        i, j = np.searchsorted(start, [at, at + PIECE])
        first[i:j] = total + up * s[start[i:j] - at]
        down[i:j] = back * DOWN[start[i:j] - at]
        i, j = np.searchsorted(end, [at + 1, at + PIECE + 1])
        last[i:j] = total + up * s[end[i:j] - at]
        total = total + up * s[-1:]
    word = mix((last - first) * down)
    padded = np.concatenate([word, np.zeros(WORDS - 1, _U)])
    return Words(start, end, word, mix(sum(padded[i : i + len(word)] * UP[i + 1] for i in range(WORDS))))


def _short(word: np.ndarray) -> np.ndarray:
    """The one shingle of under five words: all of them."""
    return mix((word * UP[1 : len(word) + 1]).sum(keepdims=True) + _U(len(word)))


def _sequences(word: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the words [a, b) of each unit; units are in order and do not overlap."""
    n = b - a
    row = np.repeat(np.arange(len(a)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    terms = mix(word[a[row] + place] ^ mix(place.astype(_U)))
    return mix(np.add.reduceat(terms, np.cumsum(n) - n) ^ mix(n.astype(_U))) if len(a) else np.array([], _U)


def units_of(data: np.ndarray, edges: np.ndarray) -> tuple[Words, list[tuple[np.ndarray, ...]]]:
    """Words of the texts, and their units as (text, start, end, first word, word after the last one, end of the shingles, whether lines) for lines, blocks and texts of under five words. Bytes count from ``edges[0]``."""
    w = words_of(data, edges)
    if not len(w.start):
        return w, []
    breaks = np.flatnonzero(data == 10)
    line = np.unique(np.concatenate([edges[:-1], breaks + 1]))
    line = line[: np.searchsorted(line, len(data))]
    text = np.searchsorted(edges, line, side="right") - 1
    opens = np.ones(len(line), bool)
    opens[1:] = text[1:] != text[:-1]
    # A line ends where the next one begins, less the line feed; the last of a text ends with it, or before the line feed that the text ends with.
    close = np.append(line[1:], len(data)) - 1
    last = np.append(opens[1:], True)
    end = edges[text[last] + 1]
    close[last] = end - ((end > line[last]) & (data[end - 1] == 10))
    first = np.searchsorted(w.start, line)
    after = np.append(first[1:], len(w.start))
    n = after - first
    some = np.flatnonzero(n >= MIN_WORDS)
    lines = (text[some], line[some], close[some], first[some], after[some], after[some] - WORDS + 1)
    short = (n > 0) & (n < SHORT)
    a = np.flatnonzero(short & (opens | ~np.append(False, short[:-1])))
    b = np.flatnonzero(short & (last | ~np.append(short[1:], False)))
    good = (b > a) & (after[b] - first[a] >= WORDS)
    a, b = a[good], b[good]
    blocks = (text[a], line[a], close[b], first[a], after[b], after[b] - WORDS + 1)
    head = np.searchsorted(w.start, edges)
    tiny = np.flatnonzero((np.diff(head) > 0) & (np.diff(head) < WORDS))
    for t in tiny:
        w.shingle[head[t]] = _short(w.hash[head[t] : head[t + 1]])[0]
    few = (tiny, w.start[head[tiny]], w.end[head[tiny + 1] - 1], head[tiny], head[tiny + 1], head[tiny] + 1)
    return w, [(*lines, True), (*blocks, False), (*few, False)]


def _bands(shingle: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One row of band keys for each stretch [a, b) of shingle hashes; stretches are in order and do not overlap."""
    own = np.append(shingle[a[0] : b[-1]], _U(0))
    edges = np.stack([a, b], axis=1).ravel() - a[0]
    least = np.empty((BANDS * ROWS, len(a)), _U)
    for i in range(BANDS * ROWS):
        least[i] = np.minimum.reduceat(own * _A[i] + _C[i], edges)[::2]
    keys = np.zeros((BANDS, len(a)), _U)
    for r in range(ROWS):
        keys = (keys ^ least[r::ROWS]) * _U(0x9E3779B97F4A7C15)
        keys ^= keys >> _U(31)
    return (keys + np.arange(BANDS, dtype=_U)[:, None] * _U(0xC2B2AE3D27D4EB4F)).T


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings without nulls, one after another, and where each begins and the last ends."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _units(docs: DataFrame) -> DataFrame:
    """(doc, th, text) -> (doc, th, start, end, words, line, pid, bands), one row for each line (``line``) and block."""
    fields = [("start", T.IntegerType()), ("end", T.IntegerType()), ("words", T.IntegerType()), ("line", T.BooleanType()), ("pid", T.LongType()), ("bands", T.ArrayType(T.LongType(), False))]
    schema = T.StructType([*docs.select("doc", "th").schema, *[T.StructField(n, t, False) for n, t in fields]])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                data, edges = bytes_of(batch.column(2))
                w, kinds = units_of(data, edges)
                for text, start, end, first, after, stop, line in kinds:
                    pid = _sequences(w.hash, first, after).view(np.int64)
                    cuts = np.searchsorted(first, np.arange(0, len(w.start) + BLOCK, BLOCK))
                    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                        if i == j:
                            continue
                        bands = _bands(w.shingle, first[i:j], stop[i:j]).view(np.int64)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel()))
                        row, zero = pa.array(text[i:j]), edges[text[i:j]]
                        cols = [pa.array(c.astype(np.int32)) for c in (start[i:j] - zero, end[i:j] - zero, after[i:j] - first[i:j])]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *cols, pa.array(np.full(j - i, line)), pa.array(pid[i:j]), lists], names=schema.names)

    return docs.mapInArrow(run, schema)


def _sets(bodies: DataFrame) -> DataFrame:
    """(pid, body) -> (pid, shingles), each shingle once and in order."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                data, edges = bytes_of(batch.column(1))
                w = words_of(data, edges)
                head = np.searchsorted(w.start, edges)
                sets = [np.unique(w.shingle[a : b - WORDS + 1]) if b - a >= WORDS else _short(w.hash[a:b]) for a, b in itertools.pairwise(head)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*sets, np.array([], _U)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["pid", "shingles"])

    return bodies.mapInArrow(run, "pid long, shingles array<long>")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Exact Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


class _Bucket:
    """Paragraphs that collide in one band."""

    def __init__(self):
        self.pids: list[int] = []
        self.sets: list[np.ndarray] = []
        self.top: list[int] = []

    def root(self, i: int) -> int:
        while self.top[i] != i:
            i = self.top[i]
        return i

    def add(self, pid: int, own: np.ndarray) -> list[tuple[int, int]]:
        """Links of a new paragraph, one for each component that it resembles a member of."""
        links, linked = [], set()
        for j, other in enumerate(self.sets):
            r = self.root(j)
            small, large = sorted((len(own), len(other)))
            if r not in linked and small >= SIMILAR * large and similarity(own, other) >= SIMILAR:
                linked.add(r)
                links.append((pid, self.pids[j]))
        self.pids.append(pid)
        self.sets.append(own)
        self.top.append(len(self.top))
        for r in linked:
            self.top[r] = self.top[-1]
        return links


def _links(members: DataFrame) -> DataFrame:
    """(band, cell, pid, shingles), a cell's rows in one task -> links (a, b)."""

    def run(batches):
        key, bucket = None, _Bucket()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch, out = whole.slice(at, 1024), []
                for band, cell, pid, own in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3), strict=True):
                    if (band, cell) != key:
                        key, bucket = (band, cell), _Bucket()
                    out += bucket.add(pid, own.values.to_numpy().view(_U))
                if out:
                    a, b = np.array(out, np.int64).T
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    ordered = members.repartition("band", "cell").sortWithinPartitions("band", "cell", F.xxhash64("band", "pid"), "pid").select("band", "cell", "pid", "shingles")
    return ordered.mapInArrow(run, "a long, b long")


def _across(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Links between two cells' rows (pid, root, shingles) of different components; components that are linked once are not compared again."""
    out, top = [], {}

    def root(i: int) -> int:
        while i in top:
            i = top[i]
        return i

    others, roots = right["_pid"].to_numpy(np.int64), right["_root"].to_numpy(np.int64)
    sizes = right["_shingles"].map(len).to_numpy()
    values = np.concatenate(right["_shingles"].to_list()) if len(right) else np.array([], np.int64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(sizes)), sizes)[order]
    for pid, r, own in zip(left["pid"], left["root"], left["shingles"], strict=True):
        first, n = (lo := np.searchsorted(values, own)), np.searchsorted(values, own, side="right") - lo
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sizes))  # shingles shared with each of the others
        for j in np.flatnonzero(both >= SIMILAR * (len(own) + sizes - both)):
            if (x := root(r)) != (y := root(int(roots[j]))):
                top[x] = y
                out.append((pid, int(others[j])))
    return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])


def _rest(large: DataFrame, sets: DataFrame, stars: DataFrame) -> DataFrame:
    """Links between the components (node, root) that members (band, pid, n) of large buckets are in. In each bucket
    the members outside its largest component meet all members, cell by cell."""
    rooted = large.join(stars, F.col("pid") == F.col("node"), "left").select("band", "pid", "n", F.coalesce("root", "pid").alias("root"))
    sizes = rooted.groupBy("band", "root").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("band").agg(F.max(F.struct("size", "root")).alias("main"), F.sum("size").alias("total")).where("total > main.size")
    main = main.select(F.col("band").alias("_band"), F.col("main.root").alias("main"), (F.col("total") - F.col("main.size")).alias("outside"))
    cell = lambda n: F.pmod(F.xxhash64("pid", "band"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = rooted.join(apart(main), F.col("band") == F.col("_band")).withColumns({"rows": F.ceil(F.col("outside") / EXACT), "cols": F.ceil(F.col("n") / EXACT)})
    left = dealt.where("root <> main").select("band", "pid", "root", cell("rows").alias("i"), every("cols").alias("j"))
    right = dealt.select("band", "pid", "root", cell("cols").alias("j"), every("rows").alias("i"))
    key = ["band", "i", "j"]
    left, right = (side.join(sets, "pid").select(*key, "pid", "root", "shingles") for side in (left, right))
    right = right.toDF(*[f"_{c}" for c in right.columns])
    return left.groupBy(*key).cogroup(right.groupBy(*[f"_{c}" for c in key])).applyInPandas(_across, "a long, b long")


def band_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members (band, pid, n) of the buckets, n being a bucket's size, and their shingles (pid, shingles) -> links (a, b) that
    join all similar paragraphs of a bucket, whatever its size."""
    cells = F.ceil(F.col("n") / EXACT)
    first = members.withColumn("cell", F.pmod(F.xxhash64("band", "pid"), cells))
    large = members.where(F.col("n") > EXACT)
    if large.isEmpty():
        return written(_links(first.join(sets, "pid")), "paragraph-links")
    rank = F.row_number().over(Window.partitionBy("band").orderBy(F.xxhash64("pid", "band"), "pid"))
    pivots = large.withColumn("rank", rank).where(F.col("rank") <= PIVOTS).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1)))
    edges = written(_links(first.unionByName(pivots.select(*first.columns)).join(sets, "pid")), "paragraph-links")
    stars = components(edges)
    return written(edges.unionByName(_rest(large, sets, stars)), "paragraph-links")


def classes(docs: DataFrame, units: DataFrame) -> DataFrame:
    """(node, root): paragraphs that are near copies of the paragraph ``root``, over links of any number."""
    firsts = written(units.groupBy("pid").agg(F.min(F.struct("doc", "th", "start", "end", "bands")).alias("one")), "paragraphs")
    banded = firsts.select("pid", F.explode("one.bands").alias("band"))
    shared = written(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "paragraph-bands")
    members = written(banded.join(shared, "band").select("band", "pid", "n"), "paragraph-members")
    release(docs.sparkSession)
    asked = firsts.join(apart(members.select("pid").distinct()), "pid").select("pid", F.col("one.doc").alias("_doc"), F.col("one.th").alias("_th"), "one.start", "one.end")
    found = docs.join(asked, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")))  # repeated rows give a body twice, which links to itself
    bodies = found.select("pid", F.expr("substring(cast(text AS binary), start + 1, end - start)").alias("body"))
    sets = written(_sets(bodies), "paragraph-sets")
    edges = band_links(members, sets)
    for table in (firsts, shared, members, sets):
        remove(table)
    release(docs.sparkSession)
    return components(edges)


def _stretches(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and hash of the stretches that begin in a byte string; words may be of several documents."""
    low = np.where((x >= 65) & (x <= 90), x + 32, x).astype(np.uint8)
    gap = np.concatenate([[True], (low == 32) | ((low >= 9) & (low <= 13)), [True]])
    start, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    none = np.array([], np.int64)
    if len(start) < PASSAGE:
        return none, none, none.view(_U)
    s = prefix_sums(low)
    word = mix((s[end] - s[start]) * DOWN[start])
    n = len(word) - WORDS + 1
    shingle = mix(sum(word[i : i + n] * UP[i + 1] for i in range(WORDS)))
    width = min(GAP, n)
    place = _U((1 << 20) - 1)
    at = np.unique(least_of((shingle & ~place) | np.arange(n, dtype=_U), width) & place).astype(np.int64)
    at = at[at + PASSAGE <= len(word)]
    run = np.concatenate([np.zeros(1, _U), np.cumsum(word * UP[: len(word)])])
    return start[at], end[at + PASSAGE - 1], mix((run[at + PASSAGE] - run[at]) * DOWN[at])


def _passages(docs: DataFrame) -> DataFrame:
    """(doc, th, text) -> (doc, th, start, size, hash) of all stretches."""
    fields = [("start", T.IntegerType()), ("size", T.IntegerType()), ("hash", T.LongType())]
    schema = T.StructType([*docs.select("doc", "th").schema, *[T.StructField(n, t, False) for n, t in fields]])

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            for a, b, i in segments(offsets, LAP):
                start, end, own = _stretches(data[a:b])
                doc = np.searchsorted(offsets, start + a, side="right") - 1
                # Within one document; of a part of a long one, what the next part does not hold whole.
                good = end + a <= offsets[doc + 1]
                if b < offsets[i + 1]:
                    good &= start < b - a - LAP
                start, size, own, doc = start[good], (end - start)[good], own[good], doc[good]
                cols = [pa.array((start + a - offsets[doc]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(own.view(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), *cols], names=schema.names)

    return docs.mapInArrow(run, schema)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc, th, start, end, of) of the stretches that an earlier document has; ``of`` is its id."""
    all_ = written(_passages(docs), "passages")
    who = F.struct("doc", "th")
    often = all_.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = written(all_.join(apart(often), "hash"), "passages-met")
    shared = met.groupBy("hash").agg(F.min(who).alias("first"), F.max(who).alias("last")).where("not (first <=> last)").drop("last")
    again = met.join(apart(shared), "hash").where(~who.eqNullSafe(F.col("first")))
    found = written(again.select("doc", "th", "start", (F.col("start") + F.col("size")).alias("end"), F.col("first.doc").alias("of")), "passages-repeated")
    remove(all_)
    remove(met)
    release(docs.sparkSession)
    return found


def paragraph_dedup(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: its id, ``n_paragraphs`` (those long enough to be compared), ``n_removed`` (of them), ``n_passages`` (further stretches
    cut out of lines, and blocks, where no removed paragraph is part of the cut), ``class_ids`` (documents that keep what was cut), ``spans`` (start, end in bytes of all cuts) and ``kept`` (the rest of the text; a paragraph takes its line end along).

    Of each class the unit stays that is first by (id, text hash, position), with the lines in it if it is a block and the block
    around it if it is a line; the class id is its document's id. Null text
    is empty. Repeated rows are copies of each other, and as they cannot be told apart they keep or lose the same. Null ids come first.
    An empty table gives an empty table.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc"), row_key(text).alias("th"), text.alias("text"))
    passages = repeated_passages(rows)
    units = written(_units(rows), "paragraph-units")
    near = classes(rows, units)
    classed = units.drop("bands").join(near, F.col("pid") == F.col("node"), "left").withColumn("class", F.coalesce("root", "pid"))
    firsts = classed.groupBy("class").agg(F.min(F.struct("doc", "th", "start", "end")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = classed.join(apart(firsts), "class", "left")
    around = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("th") == F.col("first.th")) & (F.col("start") < F.col("first.end")) & (F.col("end") > F.col("first.start"))
    gone = F.col("first").isNotNull() & ~around
    marks = met.select("doc", "th", "start", "end", F.when(gone, F.col("first.doc")).alias("of"), F.when(F.col("line"), F.when(gone, 2).otherwise(1)).when(gone, 3).alias("kind")).where("kind is not null")
    both = marks.unionByName(passages.withColumn("kind", F.lit(0)))
    per_doc = both.groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(F.array_sort(F.collect_set(F.struct("start", "end", "kind", "of"))).alias("marks"))
    texts = rows.join(per_doc, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")), "left").select("doc", F.col("text").cast("binary").alias("raw"), F.col("marks.start").alias("a"), F.col("marks.end").alias("b"), F.col("marks.kind").alias("kind"), F.col("marks.of").alias("of"))
    ids, span = rows.schema["doc"].dataType, T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([T.StructField(id_col, ids), *[T.StructField(n, T.LongType()) for n in ("n_paragraphs", "n_removed", "n_passages")], T.StructField("class_ids", T.ArrayType(ids)), T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.StringType())])

    def cut(raw: bytes, a: list, b: list, kind: list, of: list) -> tuple:
        lines = {s: (s, min(e + 1, len(raw))) for s, e, k in zip(a, b, kind, strict=True) if k == 2}
        stretches = [(s, e if k == 0 else min(e + 1, len(raw))) for s, e, k in zip(a, b, kind, strict=True) if k in (0, 3)]
        spans: list[list[int]] = []
        inside: list[bool] = []  # whether a removed line is part of the span
        for s, e, line in sorted([(s, e, True) for s, e in lines.values()] + [(s, e, False) for s, e in stretches]):
            if spans and s < spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], e)
                inside[-1] |= line
            else:
                spans.append([s, e])
                inside.append(line)
        edges = [0, *[x for s in spans for x in s], len(raw)]
        kept = b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
        others = sorted({o for o, k in zip(of, kind, strict=True) if k != 1 and o is not None})
        return sum(k in (1, 2) for k in kind), len(lines), inside.count(False), others, [{"start": s, "end": e} for s, e in spans], kept.decode()

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), None, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]
        for whole in batches:
            kinds[3] = pa.list_(whole.schema.field(0).type)
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows_ = [cut(raw.as_py(), *[x.as_py() or [] for x in marks]) for raw, *marks in zip(*[batch.column(i) for i in range(1, 6)], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(zip(*rows_, strict=True), kinds, strict=True)]], names=schema.names)

    return texts.mapInArrow(run, schema)
