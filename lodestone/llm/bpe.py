"""Byte-level BPE encoding and decoding.

A text of at most ``chunk_chars`` characters is one chunk and is encoded where
it lies. A longer one is cut into overlapping chunks which tasks pre-tokenise
in parallel. Two neighbouring chunks resynchronise at a position that both see
as the start of a pre-token inside their overlap: from there on both views agree,
as the pattern looks only forward. The text is cut at these positions, the
pieces are dealt out again and encoded, and their ids joined in order. Chunks whose
overlap holds no common start (one enormous pre-token) are merged before encoding,
with all that follows them in the text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import text_or_empty, without

#: Characters at a chunk's end whose boundaries are not believed: the pattern looks at most this far ahead of a pre-token.
MARGIN = 8


@lru_cache(maxsize=4)
def _ranks(vocab_path: str) -> dict[bytes, int]:
    with open(vocab_path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _encoding(vocab_path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=_ranks(vocab_path), special_tokens={})


@lru_cache(maxsize=4)
def _tokens(vocab_path: str) -> list[bytes]:
    ranks = _ranks(vocab_path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


def boundaries(text: str, pattern: str) -> list[int]:
    """Starts of the pre-tokens of a text."""
    import regex

    return [m.start() for m in regex.finditer(pattern, text)]


def _default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _with_ids(df: DataFrame, column: str, vocab_path: str, pattern: str) -> DataFrame:
    """Replace the string column by ``ids``."""
    schema = T.StructType([f for f in df.schema if f.name != column] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(vocab_path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(batch.schema.get_field_index(column))
                flat, ends = array("i"), array("i", [0])
                for x in texts:
                    flat.extend(enc.encode_ordinary(x.as_py() or ""))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(memoryview(flat), pa.int32()) if flat else pa.array([], pa.int32()))
                kept = [i for i, n in enumerate(batch.schema.names) if n != column]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [ids], names=[batch.schema.names[i] for i in kept] + ["ids"])

    return df.mapInArrow(run, schema)


def _long_ids(texts: DataFrame, vocab_path: str, pattern: str, chunk_chars: int, overlap: int) -> DataFrame:
    """(digest, text) rows, digests distinct -> (digest, ids)."""

    def split(batches):
        for pdf in batches:
            for digest, text in zip(pdf["digest"], pdf["text"], strict=True):
                rows = []
                for k, start in enumerate(range(0, max(1, len(text) - overlap), chunk_chars - overlap)):
                    rows.append((digest, k, start, start + chunk_chars >= len(text), text[start : start + chunk_chars]))
                yield type(pdf)(rows, columns=["digest", "k", "start", "last", "chunk"])

    def pretokenise(batches):
        for pdf in batches:
            head, tail = [], []
            for start, last, chunk in zip(pdf["start"], pdf["last"], pdf["chunk"], strict=True):
                b = [x for x in boundaries(chunk, pattern) if last or x <= len(chunk) - MARGIN]
                lap = len(chunk) if last else len(chunk) - overlap
                head.append([start + x for x in b if x <= overlap - MARGIN] if start else [])
                tail.append([] if last else [start + x for x in b if x >= lap])
            yield pdf.assign(head=head, tail=tail)

    chunks = texts.mapInPandas(split, "digest string, k int, start long, last boolean, chunk string").repartition("digest", "k")
    seen = chunks.mapInPandas(pretokenise, "digest string, k int, start long, last boolean, chunk string, head array<long>, tail array<long>")
    w = Window.partitionBy("digest").orderBy("k")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    # A cut is the first start in the overlap that this chunk and the next one agree on. A chunk that has not met its predecessor sees starts that need not be true, so its cuts, and all later ones, do not count.
    cut = F.array_min(F.array_intersect("tail", F.lead("head").over(w)))
    met = seen.withColumn("cut", cut).withColumn("cut", F.when(F.min(F.col("cut").isNotNull().cast("int")).over(so_far) == 1, F.col("cut")))
    cuts = met.withColumn("before", F.lag("cut").over(w)).drop("head", "tail")
    piece = F.sum(F.when((F.col("k") == 0) | F.col("before").isNotNull(), 1).otherwise(0)).over(so_far)
    begin = F.when(F.col("before").isNotNull(), F.col("before")).when(F.col("k") == 0, F.lit(0)).otherwise(F.col("start") + overlap)
    stop = F.when(F.col("cut").isNotNull(), F.col("cut") - F.col("start")).otherwise(F.length("chunk"))
    body = F.expr("substring(chunk, cast(begin - start + 1 as int), cast(stop - (begin - start) as int))")
    pieces = cuts.withColumn("piece", piece).withColumn("begin", begin).withColumn("stop", stop).select("digest", "piece", "k", body.alias("body"))
    joined = pieces.groupBy("digest", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "body"))), lambda x: x["body"]), "").alias("body"))
    dealt = joined.repartition("digest", "piece")
    encoded = _with_ids(dealt, "body", vocab_path, pattern)
    parts = F.array_sort(F.collect_list(F.struct("piece", "ids")))
    return encoded.groupBy("digest").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, vocab_path: str | None = None, pattern: str | None = None, *, text_col: str = "text", chunk_chars: int = 32768, overlap: int = 1024) -> DataFrame:
    """Add ``ids`` (array<int>), the ids of each whole text. An input column named ids gives way.

    A null or empty text has no ids. Repeated rows stay; long texts that are equal are encoded once.
    An empty table gives an empty table.
    """
    vocab_path, pattern = vocab_path or _default_path(), pattern or _default_pattern()
    docs = without(docs, "ids")
    order = [*docs.columns, "ids"]
    marked = docs.withColumn("_bpe_text", text_or_empty(text_col)).withColumn("_bpe_long", F.length("_bpe_text") > chunk_chars)
    short = _with_ids(marked.where("not _bpe_long").drop("_bpe_long"), "_bpe_text", vocab_path, pattern)
    long = marked.where("_bpe_long").withColumn("_bpe_digest", F.sha2("_bpe_text", 256))
    texts = long.select(F.col("_bpe_digest").alias("digest"), F.col("_bpe_text").alias("text")).dropDuplicates(["digest"])
    ids = _long_ids(texts, vocab_path, pattern, chunk_chars, overlap)
    long = long.drop("_bpe_text", "_bpe_long").join(ids, F.col("_bpe_digest") == F.col("digest")).select(*[F.col(f"`{c}`") for c in order])
    return short.select(*[F.col(f"`{c}`") for c in order]).unionByName(long)


def decode(encoded: DataFrame, vocab_path: str | None = None, *, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary), the concatenated bytes of the ids; bytes need not be whole characters. Null ids decode to no bytes."""
    vocab_path = vocab_path or _default_path()
    encoded = without(encoded, "decoded")
    schema = T.StructType([*encoded.schema, T.StructField("decoded", T.BinaryType(), False)])

    def run(batches):
        tokens = _tokens(vocab_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = batch.column(batch.schema.get_field_index(ids_col))
                raw = [b"".join(map(tokens.__getitem__, x.values.to_numpy(zero_copy_only=False).tolist())) if x.is_valid else b"" for x in ids]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
