"""Chunks, keyword, vector and hybrid search, reranking, and measures of a ranking."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.batches import pieces
from lodestone.functions.vectors import cosine

# Words that no search is made for, and how much each part of a score weighs.
IDLE = (
    "de", "la", "el", "los", "las", "del", "un", "una", "unos", "unas", "y", "o", "a", "en", "para", "que", "con", "por", "cuanto", "mejor", "cual",
    "es", "son", "hay", "me", "te", "se", "su", "sus", "esto", "esta", "ese", "esa", "al", "como", "cuales", "quiero", "busco", "recomiendame",
    "contra", "poco", "y si",
)
WEIGHTS = {"semantic": 0.35, "keyword": 0.2, "product": 0.2, "source": 0.15, "recency": 0.1}
LEAST = 0.05


def query_words(query: str, limit: int = 10) -> list[str]:
    words = dict.fromkeys(re.findall("[a-z0-9]+", query.casefold(), re.ASCII))
    return [w for w in words if len(w) > 1 and w not in IDLE][:limit]


# Where a chunk may end, the best kind first, and how far from its end such a place is looked for.
BREAKS = ("\n\n", "\n", ". ", " ")
REACH = 60
# Texts and characters that a task cuts at a time.
AT_ONCE, CHARACTERS_AT_ONCE = 256, 1_000_000


def _stretches(text: str, size: int, overlap: int):
    """(from, to) of the chunks of a text without blanks at its ends. All places to end at are found once, kind by kind, and looked up by bisection."""
    places = [(len(mark), [m.start() + len(mark) for m in re.finditer(f"(?={re.escape(mark)})", text)]) for mark in BREAKS]
    begin, last = 0, len(text)
    while begin < last:
        limit = min(begin + size, last)
        least = max(0, limit - REACH)
        for width, ends in places:
            i = bisect_right(ends, limit) - 1
            if i >= 0 and ends[i] >= least + width:
                limit = ends[i] if ends[i] > begin else limit
                break
        yield begin, limit
        if limit == last:
            return
        begin = limit - overlap if limit - overlap > begin else limit


@F.arrow_udf(T.ArrayType(T.StringType()))
def chunks(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """chunks(text, size, overlap): stretches of at most ``size`` characters that overlap; each ends after the last blank line, line end, sentence or space of its
    final REACH characters, in this order of preference. A null or blank text has none. A task cuts a few texts at a time."""

    def cut(x: str, n: int, lap: int) -> list[str]:
        parts = [x] if len(x) <= n else [x[a:b].strip() for a, b in _stretches(x, n, lap)]
        return [p for p in parts if p]

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[0]), 0).to_numpy(zero_copy_only=False)
        for a, b in pieces(sizes, AT_ONCE, CHARACTERS_AT_ONCE):
            text, size, overlap = (c.slice(a, b - a).to_pylist() for c in batch)
            yield pa.array([cut((x or "").strip(), int(n), int(lap)) for x, n, lap in zip(text, size, overlap, strict=True)], pa.list_(pa.string()))


def keyword_score(words: list[str], content: Column, title: Column, identity: Column) -> Column:
    """(content + 0.5 title + 0.75 identity hits) / words, to four places; a word hits anywhere in the text."""
    hits = lambda col: reduce(Column.__add__, [F.lower(F.coalesce(col, F.lit(""))).contains(w).cast("int") for w in words])
    return F.round((hits(content) + 0.5 * hits(title) + 0.75 * hits(identity)) / F.lit(float(len(words))), 4)


def keyword_search(chunks_: DataFrame, query: str, k: int) -> DataFrame:
    """The k best chunks (chunk_id, content, title, identity) by keywords; ties go to the smaller id."""
    words = query_words(query)
    if not words:
        return chunks_.withColumn("score", F.lit(0.0)).limit(0)
    scored = chunks_.withColumn("score", keyword_score(words, F.col("content"), F.col("title"), F.col("identity")))
    return scored.where("score > 0").orderBy(F.desc("score"), "chunk_id").limit(k)


def vector_search(vectors: DataFrame, query: Column, k: int, least: float = LEAST) -> DataFrame:
    """The k rows (chunk_id, vector) most similar to a vector."""
    scored = vectors.withColumn("score", F.round(cosine(F.col("vector"), query), 4)).where(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), "chunk_id").limit(k)


def merged(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """Hits of both searches by chunk, with the best score of each kind and the method that found it."""
    both = keyword.select("chunk_id", F.col("score").alias("keyword"), F.lit(None).cast("double").alias("semantic")).unionByName(vector.select("chunk_id", F.lit(None).cast("double").alias("keyword"), F.col("score").alias("semantic")))
    best = both.groupBy("chunk_id").agg(F.max("keyword").alias("keyword"), F.max("semantic").alias("semantic"))
    method = F.when(F.col("keyword").isNull(), "vector").when(F.col("semantic").isNull(), "keyword").otherwise("hybrid")
    return best.withColumn("method", method)


def fused_score(semantic: Column, keyword: Column, product: Column, source: Column, recency: Column, weights: dict[str, float] | None = None) -> Column:
    """The weighted sum of the parts; weights are made to add up to one, missing scores count as zero."""
    w = {**WEIGHTS, **(weights or {})}
    total = sum(w.values())
    parts = {"semantic": semantic, "keyword": keyword, "product": product, "source": source, "recency": recency}
    return F.round(reduce(Column.__add__, [F.coalesce(c, F.lit(0.0)) * F.lit(w[n] / total) for n, c in parts.items()]), 4)


def recency(days: Column) -> Column:
    """1 for today, 0 from 90 days on, 0.5 if unknown."""
    return F.when(days.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.greatest(days, F.lit(0.0)) / 90.0))


def model_likeness(chunk: Column, wanted: Column) -> Column:
    """How far two sets of model words agree: equal 1, a part of the wanted 0.5, more than the wanted 0.35, some overlap up to 0.3."""
    common = F.size(F.array_intersect(chunk, wanted))
    return (
        F.when((F.size(chunk) == 0) | (F.size(wanted) == 0), 0.5)
        .when((common == F.size(chunk)) & (common == F.size(wanted)), 1.0).when(common == F.size(chunk), 0.5).when(common == F.size(wanted), 0.35)
        .when(common == 0, 0.0).otherwise(F.least(F.lit(0.3), 0.3 * common / F.size(wanted)))
    )


def ranking_measures(hits: DataFrame, k: int) -> DataFrame:
    """Per query, from (query_id, rank, relevant): precision, recall among what was found, reciprocal rank and average precision, and true_recall if relevant_total is given."""
    order = Window.partitionBy("query_id").orderBy("rank")
    found = hits.withColumn("so_far", F.sum(F.col("relevant").cast("int")).over(order))
    rel = F.col("relevant")
    agg = found.groupBy("query_id").agg(
        F.count_if(F.col("rank") <= k).alias("_top"), F.count_if(rel & (F.col("rank") <= k)).alias("_hits"), F.count_if(rel).alias("_all"),
        F.min(F.when(rel, F.col("rank"))).alias("_first"), F.sum(F.when(rel, F.col("so_far") / F.col("rank"))).alias("_sum"),
    )
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    if "relevant_total" in hits.columns:
        total = hits.groupBy("query_id").agg(F.max("relevant_total").alias("_total"))
        agg = agg.join(total, "query_id").withColumn("true_recall", F.round(safe(F.col("_all"), F.col("_total")), 4))
    rest = [c for c in agg.columns if c == "true_recall"]
    return agg.select("query_id", F.round(safe(F.col("_hits"), F.col("_top")), 4).alias("precision_at_k"), F.round(safe(F.col("_hits"), F.col("_all")), 4).alias("recall_at_k"), F.round(F.coalesce(1.0 / F.col("_first"), F.lit(0.0)), 4).alias("mrr"), F.round(F.coalesce(F.col("_sum") / F.col("_all"), F.lit(0.0)), 4).alias("map"), *rest)


def memory_search(memories: DataFrame, words: list[str], as_of: Column, k: int) -> DataFrame:
    """Each user's best memories: 0.75 of the overlap of their words with the query's (at least 0.12), 0.15 of their importance and 0.1 of an age that halves every 45 days. memories: user_id, memory_id, content, importance, created_at."""
    own = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 2))
    asked = F.array(*[F.lit(w) for w in words if len(w) > 2])
    likeness = F.when(F.size(own) > 0, F.size(F.array_intersect(own, asked)) / F.sqrt(F.size(own).cast("double") * F.size(asked))).otherwise(0.0)
    days = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / F.lit(86_400_000_000.0)
    score = F.round(F.lit(0.75) * likeness + F.lit(0.15) * F.col("importance") / F.lit(5.0) + F.lit(0.1) * F.pow(F.lit(0.5), days / 45.0), 6)
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "memory_id")
    return memories.where(likeness >= 0.12).withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("user_id", "memory_id", "score", "rank")


def nearest(vectors: DataFrame, asked: Column, k: int, least: float, *, within: str | None = None, block: int = 8192, queries: int = 1024) -> DataFrame:
    """The k vectors (vec_id, embedding) of the greatest cosine, ``least`` or more, for each row that the condition ``asked`` holds for, the row
    itself too: query_id, rank, vec_id, score. With ``within`` only vectors that have the query's value in that column."""
    also = [within] if within else []
    return nearest_to(vectors, vectors.where(asked).select(F.col("vec_id").alias("query_id"), "embedding", *also), k, least, within=within, block=block, queries=queries)


def nearest_to(vectors: DataFrame, asked: DataFrame, k: int, least: float, *, many: int | None = None, within: str | None = None, block: int = 8192, queries: int = 1024) -> DataFrame:
    """The k vectors (vec_id, embedding) of the greatest cosine, ``least`` or more, for each row of asked (query_id, embedding): query_id, rank, vec_id, score.

    Every block of queries meets every block of vectors and keeps its k best; ties go to the smaller id. Null vectors, those with null or
    NaN components and zero vectors take no part; vectors of other lengths, or of another value of ``within``, do not meet. ``many`` is how many vectors there are at most,
    where that is known without counting them.
    """
    import numpy as np

    def sound(df: DataFrame, name: str) -> DataFrame:
        good = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v))
        group = F.concat_ws("/", F.size("embedding"), F.to_json(F.struct(F.col(within)))) if within else F.size("embedding").cast("string")
        return df.where(good).select(name, F.col("embedding").cast("array<double>").alias("vec"), group.alias("dims"))

    rows, wanted = sound(vectors, "vec_id"), sound(asked, "query_id")
    n, m = rows.count() if many is None else many, wanted.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // queries))
    cell = lambda name, among: F.pmod(F.xxhash64(name), F.lit(among)).cast("int")
    every = lambda among: F.explode(F.sequence(F.lit(0), F.lit(among - 1)))
    left = rows.select("dims", "vec_id", "vec", cell("vec_id", blocks).alias("i"), every(query_blocks).alias("j"))
    right = wanted.select(F.col("dims").alias("_dims"), "query_id", F.col("vec").alias("query"), cell("query_id", query_blocks).alias("_j"), every(blocks).alias("_i"))

    def best(some: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], np.float64)})]
        if len(some) and len(own):
            some = some.sort_values("vec_id")
            ids, x = some["vec_id"].to_numpy(np.int64), np.stack(some["vec"].to_numpy())
            norms = np.sqrt((x * x).sum(axis=1))
            for at in range(0, len(own), 128):
                names, qs = own["query_id"].to_numpy(np.int64)[at : at + 128], np.stack(own["query"].to_numpy()[at : at + 128])
                both = norms[None, :] * np.sqrt((qs * qs).sum(axis=1))[:, None]
                rough = np.divide(qs @ x.T, both, out=np.full(both.shape, -2.0), where=both > 0)
                # A matrix product adds in an order of its own: what it finds, and what is as near as rounding, is summed again row by row.
                last = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(names), -1.5)
                row, col = np.nonzero(rough >= np.maximum(last, least)[:, None] - 1e-9)
                scores = (x[col] * qs[row]).sum(axis=1) / both[row, col]
                order = np.lexsort((ids[col], -scores, row))
                row, col, scores = row[order], col[order], scores[order]
                sizes = np.bincount(row, minlength=len(names))
                place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                kept = (place < k) & (scores >= least)
                out.append(pd.DataFrame({"query_id": names[row[kept]], "vec_id": ids[col[kept]], "score": scores[kept]}))
        return pd.concat(out[1:] or out)

    found = left.groupBy("dims", "i", "j").cogroup(right.groupBy("_dims", "_i", "_j")).applyInPandas(best, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sparse_nearest(sums: DataFrame, asked: DataFrame, k: int, least: float) -> DataFrame:
    """The same for few queries and vectors as rows of their components other than zero: sums (vec_id, bucket, v), asked (query_id, bucket, v).

    Components meet in a join on the bucket and are added up per vector; only vectors that share a bucket with a query can have a
    cosine over zero, so ``least`` is to be positive. Vectors are never made dense nor copied to blocks of queries.
    """
    own = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_norm"))
    wanted = asked.groupBy("bucket").agg(F.lit(True).alias("_asked"))  # as many as there are buckets
    # One pass over the components: each vector's norm, and those of its components that some query has.
    marked = sums.join(F.broadcast(wanted), "bucket", "left")
    some = F.collect_list(F.when(F.col("_asked"), F.struct("bucket", "v"))).alias("some")
    per = marked.groupBy("vec_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), some)
    met = per.select("vec_id", "norm", F.explode("some").alias("x")).select("vec_id", "norm", "x.bucket", "x.v")
    met = met.join(asked.select("query_id", "bucket", F.col("v").alias("q")), "bucket")
    dots = met.groupBy("query_id", "vec_id", "norm").agg(F.sum(F.col("v") * F.col("q")).alias("dot")).where("dot > 0")
    scored = dots.join(own, "query_id").withColumn("score", F.col("dot") / (F.col("norm") * F.col("_norm")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    found = scored.where(F.col("score") >= least).withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
