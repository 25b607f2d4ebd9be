"""Substring dedup by prefix-free parsing.

A byte that lies in a LENGTH-byte string which also starts anywhere else is removed.

* Parse. A rolling hash over GRAM bytes picks triggers: of the grams in each LENGTH-byte
  window the one with the least hash. Equal windows hold equal triggers at equal
  offsets. Consecutive windows with one trigger are a run, and the run's bytes, from its
  first window's start to its last one's end, are its phrase. Phrases overlap by LENGTH - 1
  bytes, so that every window lies in one phrase whole.
* Order of the parse. As phrases hold their windows whole, the suffixes of the parse need to be ordered by
  their first phrase only: runs with equal triggers and equal phrases are neighbours, and where two
  runs share a phrase all their windows repeat. That is nearly all of highly repetitive text.
* Dictionary. Each different phrase is in it once. A phrase whose trigger no other phrase has is done with. Of the
  others a suffix array is made, trigger by trigger, as suffixes under different triggers never share LENGTH bytes: prefix
  doubling ranks all suffixes by their first 8, 16, 32, 64, 128 and LENGTH bytes, from the bytes themselves.
* Corpus order. A window's place is its suffix's rank in the dictionary, then its run's in the parse. It repeats if it
  shares LENGTH bytes with a neighbour: a run of its own phrase (the parse), or the next suffix (the dictionary).

Triggers with very many phrases are not held in one task: the windows of their phrases are dealt out by
hashes of 128 bits (of the trigger and the window), and equal ones counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import apart, release, remove, row_key, text_or_empty, written

LENGTH, GRAM = 200, 32
#: Grams in a window; bytes that are hashed together (a power of two).
_GRAMS, _SEGMENT = LENGTH - GRAM + 1, 1 << 17
#: Phrases of one trigger whose suffix array is made in one task; the windows of larger groups are dealt out one by one instead.
GROUP = 4096

_U = np.uint64
BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(1).integers(0, 2**64, 256, dtype=_U)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    np.multiply.accumulate(np.full(n - 1, base, _U), out=out[1:])
    return out


UP, DOWN = _powers(BASE, _SEGMENT + 1), _powers(pow(BASE, -1, 2**64), _SEGMENT + 1)


def mix(x: np.ndarray) -> np.ndarray:
    for k in (32, 29):
        x = (x ^ (x >> _U(k))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def prefix_sums(x: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x) + 1, _U)
    np.cumsum(_BYTES[x] * UP[: len(x)], out=s[1:])
    return s


def least_of(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.iinfo(_U).max, _U)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, width)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


def runs(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows in documents that lie one after another: gram, phrase, first window, last window, trigger."""
    s = prefix_sums(x)
    grams = mix((s[GRAM:] - s[: len(x) - GRAM + 1]) * DOWN[: len(x) - GRAM + 1])
    low = _U(_SEGMENT - 1)
    trigger = (least_of((grams & ~low) | np.arange(len(grams), dtype=_U), _GRAMS) & low).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    across = np.zeros(len(x) + 1, np.int64)
    np.add.at(across, np.maximum(starts, ends - LENGTH + 1), 1)
    np.add.at(across, ends, -1)
    whole = np.cumsum(across)[: len(trigger)] == 0
    new = np.ones(len(trigger), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(trigger)) - 1
    first, last = first[whole[first]], last[whole[first]]
    at = trigger[first]
    phrase = (s[last + LENGTH] - s[first]) * DOWN[first]
    return grams[at], mix(phrase ^ mix(((at - first) << 8 | (last - first)).astype(_U))), first, last, at


def windows(x: np.ndarray) -> np.ndarray:
    """Hashes of all windows of a byte string no longer than a segment."""
    s = prefix_sums(x)
    return mix((s[LENGTH:] - s[: len(x) - LENGTH + 1]) * DOWN[: len(x) - LENGTH + 1])


def suffix_ranks(x: np.ndarray) -> np.ndarray:
    """The rank of each suffix by its first LENGTH bytes; equal ranks are equal bytes. Suffixes that are shorter have no rank that counts."""
    n = len(x) - LENGTH + 1
    wide = np.concatenate([x, np.zeros(8, np.uint8)])
    rank = np.zeros(len(x), _U)
    for i in range(8):
        rank = (rank << _U(8)) | wide[i : i + len(x)]
    depth = 8
    while depth < LENGTH:
        order = np.unique(rank, return_inverse=True)[1]
        step = min(depth, LENGTH - depth)  # the last two stretches overlap
        after = np.zeros(len(x), np.int64)
        after[: len(x) - step] = order[step:]
        rank = order * np.int64(len(x) + 1) + after
        depth += step
    return rank[:n]


def segments(offsets: np.ndarray, lap: int = LENGTH - 1):
    """(from, to, first document) of what is hashed together: as many documents as fit, or a part of one that doesn't fit. Parts overlap by ``lap`` bytes, a window less one by default."""
    i, n = 0, len(offsets) - 1
    while i < n:
        a, j = offsets[i], i + 1
        while j < n and offsets[j + 1] - a < _SEGMENT:
            j += 1
        if offsets[j] - a < _SEGMENT:
            yield a, offsets[j], i
        else:
            for b in range(a, offsets[j] - lap, _SEGMENT - 1 - lap):
                yield b, min(offsets[j], b + _SEGMENT - 1), i
        i = j


def _parsed(docs: DataFrame) -> DataFrame:
    """(doc, th, text) -> (doc, th, gram, phrase, start, size, at): a run's first window, its windows, its trigger's place in it."""
    schema = T.StructType([*docs.select("doc", "th").schema, *[T.StructField(n, t, False) for n, t in (("gram", T.LongType()), ("phrase", T.LongType()), ("start", T.IntegerType()), ("size", T.ShortType()))]])

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            for a, b, i in segments(offsets):
                if b - a < LENGTH:
                    continue
                ends = np.minimum(offsets[i + 1 :], b)
                ends = ends[: np.searchsorted(ends, b) + 1] - a
                gram, phrase, first, last, _ = runs(data[a:b], ends)
                doc = i + np.searchsorted(ends, first, side="right")
                cols = [pa.array(gram.view(np.int64)), pa.array(phrase.view(np.int64)), pa.array((first + a - offsets[doc]).astype(np.int32)), pa.array((last - first + 1).astype(np.int16))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), *cols], names=schema.names)

    return docs.mapInArrow(run, schema)


def _hashed(rows: DataFrame) -> DataFrame:
    """(doc, th, gram, start, open, bytes) -> one row for each window: (doc, th, gram, start, open, window)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                hashes = [windows(np.frombuffer(b.as_py(), np.uint8)) for b in part.column(5)]
                n = np.array([len(h) for h in hashes])
                row = pa.array(np.repeat(np.arange(len(n)), n))
                within = np.concatenate([np.arange(k) for k in n]) if len(n) else np.array([], np.int64)
                cols = [part.column(i).take(row) for i in range(5)]
                cols[3] = pa.array((cols[3].to_numpy() + within).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(hashes).view(np.int64) if hashes else [], pa.int64())], names=[*part.schema.names[:5], "window"])

    schema = T.StructType([*rows.schema.fields[:5], T.StructField("window", T.LongType(), False)])
    return rows.mapInArrow(run, schema)


def _ordered(rows: DataFrame) -> DataFrame:
    """(doc, th, gram, start, open, bytes), the dictionary's phrases of a trigger in one task -> (doc, th, start, bytes covered) of the open phrases' windows that repeat."""
    schema = T.StructType([*rows.select("doc", "th", "start").schema, T.StructField("n", T.IntegerType(), False)])

    def settle(table: pa.Table) -> pa.RecordBatch:
        start = table["start"].to_numpy().astype(np.int64)
        is_open = table["open"].to_numpy(zero_copy_only=False)
        parts = [np.frombuffer(b.as_py(), np.uint8) for b in table["bytes"]]
        length = np.array([len(p) for p in parts])
        size = length - LENGTH + 1
        row = np.repeat(np.arange(len(parts)), size)
        within = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        where = start[row] + within
        rank = suffix_ranks(np.concatenate(parts))[(np.cumsum(length) - length)[row] + within]
        order = np.argsort(rank, kind="stable")  # the suffix array
        same = rank[order][1:] == rank[order][:-1]  # neighbours that share LENGTH bytes
        twice = np.zeros(len(row), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.flatnonzero(twice & is_open[row])
        cut = np.ones(len(hit), bool)
        cut[1:] = (np.diff(where[hit]) != 1) | (np.diff(row[hit]) != 0)
        head = np.flatnonzero(cut)
        n = np.diff(np.append(head, len(hit))) + LENGTH - 1
        which = pa.array(row[hit[head]])
        doc, th = (table[c].combine_chunks().take(which) for c in ("doc", "th"))
        return pa.RecordBatch.from_arrays([doc, th, pa.array(where[hit[head]].astype(np.int32)), pa.array(n.astype(np.int32))], names=schema.names)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column(2).to_numpy()
            cut = int(np.searchsorted(gram, gram[-1], side="left"))  # the last gram may go on in the next batch
            if cut:
                yield settle(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif held and held[0].column(2)[0].as_py() != gram[0]:
                yield settle(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield settle(pa.Table.from_batches(held))

    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, schema)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, th, text) -> (doc, th, start, n): stretches of bytes whose windows repeat; they may overlap."""
    parsed = written(_parsed(docs), "parse")
    grams = written(parsed.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "parse-grams")
    shared = written(parsed.join(grams, "gram"), "parse-shared")
    remove(parsed)
    remove(grams)
    release(docs.sparkSession)
    entries = shared.groupBy("gram", "phrase").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "th", "start", "size")).alias("one"))
    entries = written(entries, "dictionary")
    mixed = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("entries"), F.min("n").alias("least")).where("entries > 1 and least = 1")
    asked = entries.join(apart(mixed), "gram").select("one.doc", "one.th", "gram", "one.start", (F.col("n") == 1).alias("open"), "one.size", "entries")
    asked = asked.select(F.col("doc").alias("_doc"), F.col("th").alias("_th"), "gram", "start", "open", "size", "entries")
    found = docs.join(asked, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")))
    body = F.expr(f"substring(cast(text AS binary), start + 1, size + {LENGTH - 1})").alias("bytes")
    cut = written(found.select("doc", "th", "gram", "start", "open", body, "entries"), "dictionary-ends")
    few = _ordered(cut.where(F.col("entries") <= GROUP).drop("entries"))
    each = _hashed(cut.where(F.col("entries") > GROUP).drop("entries"))
    twice = each.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    many = each.where("open").join(apart(twice), ["gram", "window"]).select("doc", "th", "start", F.lit(LENGTH).alias("n"))
    ends = written(few.unionByName(many), "repeats-ends")
    remove(cut)
    release(docs.sparkSession)
    whole = shared.join(entries.where("n > 1").select("gram", "phrase"), ["gram", "phrase"]).select("doc", "th", "start", (F.col("size") + LENGTH - 1).cast("int").alias("n"))
    return whole.unionByName(ends)


def _spans(begin: list[int], size: list[int]) -> np.ndarray:
    """Overlapping and touching stretches -> maximal spans (start, end)."""
    order = np.argsort(begin, kind="stable")
    a = np.asarray(begin)[order]
    b = np.maximum.accumulate(a + np.asarray(size)[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    first = np.flatnonzero(new)
    return np.stack([a[first], b[np.append(first[1:], len(a)) - 1]], axis=1)


def remove_repeats(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: its id, ``n_bytes``, ``n_removed``, ``spans`` (start, end of the removed stretches) and ``kept`` (binary, not always whole characters).

    Null text is empty; texts under LENGTH bytes keep all. Repeated rows repeat each other. Null ids are ids like others.
    An empty table gives an empty table.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc"), row_key(text).alias("th"), text.alias("text"))
    stretches = repeats(rows).groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(F.collect_set(F.struct("start", "n")).alias("stretches"))
    met = rows.join(stretches, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("th") == F.col("_th")), "left").select("doc", F.col("text").cast("binary").alias("text"), F.col("stretches.start").alias("a"), F.col("stretches.n").alias("n"))
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([T.StructField(id_col, rows.schema["doc"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                n, gone, spans, kept = [], [], [], []
                for text, a, size in zip(*[batch.column(i) for i in (1, 2, 3)], strict=True):
                    raw = text.as_py()
                    own = _spans(a.as_py(), size.as_py()) if a.is_valid and len(a) else np.empty((0, 2), np.int64)
                    edges = [0, *own.ravel().tolist(), len(raw)]
                    n.append(len(raw))
                    gone.append(int((own[:, 1] - own[:, 0]).sum()))
                    spans.append([{"start": s, "end": e} for s, e in own.tolist()])
                    kept.append(b"".join(raw[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=schema.names)

    return met.mapInArrow(run, schema)
