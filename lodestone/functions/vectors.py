"""Embeddings without a model, and similarities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 if the lengths differ or a vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def bucket(token: Column) -> Column:
    """(index, sign) of a token: the first eight bytes of its SHA-256 modulo DIMENSIONS, and the bit above."""
    digest = F.sha2(token, 256)
    index = F.conv(F.substring(digest, 15, 2), 16, 10).cast("int")
    sign = F.conv(F.substring(digest, 14, 1), 16, 10).cast("int") % 2 * 2 - 1
    return F.struct(index.alias("index"), sign.alias("sign"))


def hash_sums(words: DataFrame, key: str) -> DataFrame:
    """(key, token) rows, tokens of a key different -> the sums of signs as rows (key, bucket, v). Grouped sums: no text's words are folded in one row."""
    marks = words.select(key, bucket(F.col("token")).alias("m"))
    return marks.groupBy(key, F.col("m.index").alias("bucket")).agg(F.sum("m.sign").cast("double").alias("v"))


def hash_rows(words: DataFrame, key: str) -> DataFrame:
    """(key, token) rows, tokens of a key different -> the normal vector of each key as rows (key, bucket, value)."""
    sums = hash_sums(words, key)
    norms = sums.groupBy(F.col(key).alias("_key")).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return sums.join(norms, F.col(key) == F.col("_key")).where("v <> 0").select(key, "bucket", (F.col("v") / F.col("norm")).alias("value"))


def hash_vectors(words: DataFrame, key: str) -> DataFrame:
    """The same as arrays: (key, embedding), not made normal, so that every component is a whole number and cosines do not hang on an order of sums.

    A key without tokens has no vector; a group never has more than DIMENSIONS rows.
    """
    per = hash_sums(words, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "v"))).alias("m"))
    every = F.sequence(F.lit(0), F.lit(DIMENSIONS - 1))
    return per.select(key, F.transform(every, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("embedding"))
