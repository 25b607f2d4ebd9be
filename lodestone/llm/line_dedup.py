"""Line dedup that can be undone: sharded cuckoo filters backed by exact reference-count tables.

The exact tables hold which documents have which line (``postings``) and how
many documents have it and which is the last (``counts``). A line held by
enough documents is droppable; its key is then in the cuckoo filter of its
shard. Documents are cleaned by sending their line keys past the filters,
which turns nearly all of them away, and checking what passes against the
exact counts. Inserting documents adds the keys that become droppable to the
filters; deleting documents takes out those that no longer are.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import text_or_empty, without, written
from lodestone.llm.cuckoo import CuckooFilter, built

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys in a shard's filter, and slices in which a shard's lines go past copies of its filter.
SHARD_KEYS, SLICES = 250_000, 64
#: Dropped lines of a document up to which they are looked through; more are searched by halving.
FEW = 64

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANK = " \t\n\x0b\f\r"


class LineIndex(NamedTuple):
    postings: DataFrame  # h1, h2, doc: each once
    counts: DataFrame  # h1, h2, n_docs, last_doc
    filters: DataFrame  # shard, filter
    shards: int


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _UPPER.lower())


def _hashed(line: Column) -> Column:
    """128 bits for a key; null for a key that is too short."""
    key = line_key(line)
    return F.when(F.length(key) >= MIN_CHARS, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2")))


def line_keys(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc, h1, h2), once for each row and key of at least MIN_CHARS characters."""
    lines = F.array_distinct(F.transform(F.split(text_or_empty(text_col), "\n"), _hashed))
    keys = docs.select(F.col(id_col).alias("doc"), F.explode(lines).alias("k")).where("k is not null")
    return keys.select("doc", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))


def _count(postings: DataFrame) -> DataFrame:
    return postings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last_doc"))


def _shard(shards: int) -> Column:
    return F.pmod(F.col("h1"), F.lit(shards)).cast("int").alias("shard")


def _filters(counts: DataFrame, shards: int) -> DataFrame:
    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "filter": [built(pdf["h2"].to_numpy()).to_bytes()]})

    keys = counts.where(F.col("n_docs") >= MIN_DOCS).select(_shard(shards), "h2")
    return keys.groupBy("shard").applyInPandas(make, "shard int, filter binary")


def _shards_for(counts: DataFrame) -> int:
    return max(1, -(-counts.where(F.col("n_docs") >= MIN_DOCS).count() // SHARD_KEYS))


def build(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> LineIndex:
    """The index of a first load of documents."""
    postings = written(line_keys(docs, text_col, id_col).distinct(), "line-postings")
    counts = written(_count(postings), "line-counts")
    shards = _shards_for(counts)
    return LineIndex(postings, counts, written(_filters(counts, shards), "line-filters"), shards)


def _changed(index: LineIndex, postings: DataFrame, touched: DataFrame) -> LineIndex:
    """The index after its postings changed for the touched keys: their counts are made anew, and the filters of their shards follow. Where the
    keys outgrow the shards twice, all filters are made anew over more of them."""
    postings = written(postings, "line-postings")
    fresh = _count(postings.join(touched, ["h1", "h2"], "left_semi"))
    counts = written(index.counts.join(touched, ["h1", "h2"], "left_anti").unionByName(fresh), "line-counts")
    if (shards := _shards_for(counts)) > 2 * index.shards:
        return LineIndex(postings, counts, written(_filters(counts, shards), "line-filters"), shards)
    was = index.counts.where(F.col("n_docs") >= MIN_DOCS).select("h1", "h2").join(touched, ["h1", "h2"], "left_semi")
    now = counts.where(F.col("n_docs") >= MIN_DOCS).select("h1", "h2").join(touched, ["h1", "h2"], "left_semi")
    steps = now.join(was, ["h1", "h2"], "left_anti").withColumn("add", F.lit(True)).unionByName(was.join(now, ["h1", "h2"], "left_anti").withColumn("add", F.lit(False)))
    steps = steps.select(_shard(index.shards), "h2", "add")
    overfull = "shard int, filter binary, full boolean"

    def apply(key, olds: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter.from_bytes(olds["filter"].iloc[0]) if len(olds) else CuckooFilter.sized(1024)
        f.remove(changes.loc[~changes["add"].astype(bool), "h2"].to_numpy(np.int64))
        good = f.add(changes.loc[changes["add"].astype(bool), "h2"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [np.int32(key[0])], "filter": [f.to_bytes()], "full": [not good]})

    filters = written(index.filters.groupBy("shard").cogroup(steps.groupBy("shard")).applyInPandas(apply, overfull), "line-filters")
    again = filters.where("full").select("shard")
    rebuilt = _filters(counts.join(again, _shard(index.shards) == again["shard"], "left_semi"), index.shards)
    return LineIndex(postings, counts, filters.where("not full").drop("full").unionByName(rebuilt), index.shards)


def insert(index: LineIndex, docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> LineIndex:
    """The index with more documents; lines that a known document has already count once."""
    new = written(line_keys(docs, text_col, id_col).distinct(), "line-new")
    return _changed(index, index.postings.unionByName(new).distinct(), new.select("h1", "h2").distinct())


def delete(index: LineIndex, ids: DataFrame, *, id_col: str = "doc_id") -> LineIndex:
    """The index without these documents, as if they had never been inserted."""
    gone = index.postings.join(ids.select(F.col(id_col).alias("doc")).distinct(), "doc", "left_semi")
    left = index.postings.join(ids.select(F.col(id_col).alias("doc")).distinct(), "doc", "left_anti").select("h1", "h2", "doc")
    return _changed(index, left, gone.select("h1", "h2").distinct())


def _passing(keys: DataFrame, index: LineIndex) -> DataFrame:
    """The (doc, h1, h2) which the filters let through. Lines of a shard are dealt into slices, and each slice meets a copy of the shard's filter."""
    none = F.lit(None)
    lines = keys.select(_shard(index.shards), F.pmod(F.xxhash64("doc"), F.lit(SLICES)).cast("int").alias("slice"), "doc", "h1", "h2", none.cast("binary").alias("filter"))
    copies = index.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"), none.cast(keys.schema["doc"].dataType).alias("doc"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), "filter")
    met = lines.unionByName(copies).repartition("shard", "slice").sortWithinPartitions("shard", "slice", F.col("filter").isNull())

    def probe(batches):
        at, f = None, None
        for batch in batches:
            shard, part, h2 = (batch.column(i).to_numpy() for i in (0, 1, 4))
            edge = np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0)) + 1
            passes = np.zeros(len(shard), bool)
            for a, b in zip([0, *edge], [*edge, len(shard)], strict=True):
                if a == b:
                    continue
                if (here := (shard[a], part[a])) != at:
                    at, f = here, None
                if batch.column(5)[a].is_valid:  # a slice begins with its filter, if the shard has one
                    f = CuckooFilter.from_bytes(batch.column(5)[a].as_py())
                    a += 1
                if f is not None and a < b:
                    passes[a:b] = f.contains(h2[a:b])
            yield batch.select([2, 3, 4]).filter(pa.array(passes))

    return met.mapInArrow(probe, keys.schema)


def drops(keys: DataFrame, index: LineIndex) -> DataFrame:
    """(doc, h1, h2) of the lines that leave a document: droppable ones, except in the last document that has them."""
    counts = index.counts.where(F.col("n_docs") >= MIN_DOCS)
    checked = _passing(keys, index).join(counts, ["h1", "h2"])
    return checked.where(~F.col("doc").eqNullSafe(F.col("last_doc"))).select("doc", "h1", "h2")


def _among(drop: Column, key: Column) -> Column:
    """Whether a sorted array holds the key: looked through if short, else searched by halving."""
    n = F.size(drop)
    steps = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at <= n - step) & (F.get(drop, at + step - 1) < key), at + step).otherwise(at))
    return F.when(key.isNull(), F.lit(False)).when(n <= FEW, F.array_contains(drop, key)).otherwise(F.coalesce(F.get(drop, below) == key, F.lit(False)))


def clean(docs: DataFrame, index: LineIndex, *, text_col: str = "text", id_col: str = "doc_id", keys: DataFrame | None = None) -> DataFrame:
    """The documents with dropped lines taken out of the text, and ``n_lines`` (before) and ``n_dropped``. ``keys`` are their
    postings (doc, h1, h2), if they are known already.

    Null or empty text is one empty line. Input columns n_lines and n_dropped give way. All rows with a null id
    count as one document, which is never the last. Repeated rows stay. An empty table gives an empty table.
    """
    docs = without(docs, "n_lines", "n_dropped")
    keys = line_keys(docs, text_col, id_col).distinct() if keys is None else keys
    per_doc = drops(keys, index).groupBy(F.col("doc").alias("_line_doc")).agg(F.array_sort(F.collect_set(F.struct("h1", "h2"))).alias("_line_drop"))
    met = docs.join(per_doc, F.col(id_col).eqNullSafe(F.col("_line_doc")), "left")
    lines = F.split(text_or_empty(text_col), "\n")
    keyed = F.transform(lines, lambda x: F.struct(x.alias("line"), _hashed(x).alias("key")))
    left = F.transform(F.filter(keyed, lambda x: ~_among(F.col("_line_drop"), x["key"])), lambda x: x["line"])
    parts = met.withColumn("_line_kept", F.when(F.col("_line_drop").isNull(), lines).otherwise(left)).withColumn("n_lines", F.size(lines).cast("long"))
    parts = parts.withColumn("n_dropped", F.col("n_lines") - F.size("_line_kept"))
    return parts.select(*[F.array_join("_line_kept", "\n").alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns], "n_lines", "n_dropped")


def line_dedup(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Index these documents and clean them by it; their postings serve both. What ``clean`` states holds."""
    index = build(docs, text_col=text_col, id_col=id_col)
    return clean(docs, index, text_col=text_col, id_col=id_col, keys=index.postings.select("doc", "h1", "h2"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT l.doc_id, l.i, l.line, c.k IS NOT NULL AND l.doc_id <> c.last_doc AS gone FROM keyed l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
