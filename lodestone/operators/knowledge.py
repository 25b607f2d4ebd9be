"""Documents of a knowledge base: filters, candidates by words, hybrid search over words and vectors, candidate lists for a model, grouped evidence, and what a message names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import unmarked
from lodestone.functions.vectors import cosine
from lodestone.operators.names import similar_names
from lodestone.operators.substrings import absent, held

# Words of a query that candidates are looked for by at most, the least similarity, candidates for a model and the least likeness of names among them.
CANDIDATE_WORDS, LEAST, MODEL_CANDIDATES, ALIKE = 8, 0.05, 8, 0.5


def documents_where(docs: DataFrame, *, product_ids: list[int] | None = None, product_id: int | None = None, brand: str | None = None, model: str | None = None, **equal: str | None) -> DataFrame:
    """Documents of some products (several rather than one, where both are given), with a brand and model that hold the words, and equal values in further columns."""
    if product_ids:
        docs = docs.where(F.col("product_id").isin(product_ids))
    elif product_id is not None:
        docs = docs.where(F.col("product_id") == product_id)
    for name, word in (("brand", brand), ("model", model)):
        docs = docs.where(F.col(name).ilike(f"%{word}%")) if word else docs
    for name, value in equal.items():
        docs = docs.where(F.col(name) == value) if value is not None else docs
    return docs


def with_some_word(docs: DataFrame, words: list[str], *cols: str) -> DataFrame:
    """Documents that hold one of the first CANDIDATE_WORDS words in one of the columns; all of them without words."""
    some = [F.col(c).ilike(f"%{w}%") for w in words[:CANDIDATE_WORDS] for c in cols]
    return docs.where(reduce(Column.__or__, some)) if some else docs


def hybrid(docs: DataFrame, words: list[str], vector: list[float], k: int) -> DataFrame:
    """The k best of the 2 k best by words and the 2 k best by vectors (doc_id, content, vector): doc_id, keyword, semantic, score = 0.35 semantic + 0.2 keyword.

    The keyword score is the share of the words that the content holds; vectors are compared among documents with some word, from a similarity of LEAST. Ties go to the smaller id.
    """
    said = F.lower(F.coalesce("content", F.lit("")))
    share = reduce(Column.__add__, [said.contains(w).cast("int") for w in words], F.lit(0)) / F.lit(float(max(1, len(words))))
    likeness = cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in vector]))
    rows = with_some_word(docs, words, "content").select("doc_id", F.round(share, 6).alias("keyword"), F.round(likeness, 6).alias("semantic"))
    best = lambda col, least: rows.where(F.col(col) >= least).orderBy(F.desc(col), "doc_id").limit(2 * k)
    pool = best("keyword", 1e-9).unionByName(best("semantic", LEAST)).distinct()
    score = F.round(0.35 * F.when(F.col("semantic") >= LEAST, F.col("semantic")).otherwise(0.0) + 0.2 * F.col("keyword"), 6)
    return pool.withColumn("score", score).orderBy(F.desc("score"), "doc_id").limit(k)


def knowledge_confidence(priority: Column) -> Column:
    """How far evidence from the knowledge base is trusted, by its source's priority."""
    return F.least(F.lit(0.95), 0.35 + 0.6 * priority / 60.0)


def model_candidates(offers: DataFrame, products: DataFrame, *, most: int = MODEL_CANDIDATES) -> DataFrame:
    """At most ``most`` products of its brand for each offer (offer_id, brand, mpn, model, name): by part number, then by model, then by similar names: offer_id, product_id, strategy (0 to 2), rank.

    Keys are compared without case and separators; names once for each pair of different names of a brand. A product stands once, under its first strategy.
    """
    mpn = lambda c: F.regexp_replace(F.upper(c), r"[\s\-_./\\]+", "")
    shape = lambda df, key: df.select(key, F.lower("brand").alias("b"), mpn("mpn").alias("m"), F.lower(F.trim("model")).alias("d"), F.lower("name").alias("n"))
    left, right = shape(offers, "offer_id"), shape(products, "product_id")

    def same(key: str, strategy: int) -> DataFrame:
        """The ``most`` smallest products of each key; they are found before they meet the offers, so a common key makes no pairs of all that have it."""
        first = Window.partitionBy("b", key).orderBy("product_id")
        few = right.where(f"{key} <> '' and b is not null").select("b", key, "product_id").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).drop("_n")
        return left.select("b", key, "offer_id").join(few, ["b", key]).select("offer_id", "product_id", F.lit(strategy).alias("strategy"), F.lit(1.0).alias("score"))

    grouped = lambda df: df.select(F.col("b").alias("group"), F.col("n").alias("name"))
    close = similar_names(grouped(left), grouped(right), ALIKE).select(F.col("group").alias("b"), F.col("a").alias("n"), F.col("b").alias("o"), "score")
    first = Window.partitionBy("b", "o").orderBy("product_id")
    # A list can hold ``most`` products of a name at most beside those of the other strategies, which are as many at most.
    few = right.select("b", F.col("n").alias("o"), "product_id").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= 2 * most).drop("_n")
    order = Window.partitionBy("b", "n").orderBy(F.desc("score"), "product_id")
    named = close.join(few, ["b", "o"]).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= 2 * most)
    similar = left.join(named, ["b", "n"]).select("offer_id", "product_id", F.lit(2).alias("strategy"), "score")
    all_ = same("m", 0).unionByName(same("d", 1)).unionByName(similar)
    once = all_.groupBy("offer_id", "product_id").agg(F.min(F.struct("strategy", (-F.col("score")).alias("minus"))).alias("best"))
    rank = F.row_number().over(Window.partitionBy("offer_id").orderBy("best.strategy", "best.minus", "product_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select("offer_id", "product_id", "best.strategy", "rank")


def cache_key(offer: Column, candidates: Column) -> Column:
    """A key of 32 hex digits for a model's answer about an offer and its candidates, in whatever order these came."""
    return F.substring(F.sha2(F.to_json(F.struct(F.array_sort(candidates).alias("candidates"), offer.alias("offer"))), 256), 1, 32)


def ask_model(rungs: DataFrame) -> DataFrame:
    """Adds whether a model is asked about an offer (status, strategy): only if it is ambiguous by similar names; two products by one key are for people."""
    return rungs.withColumn("ask", F.coalesce((F.col("status") == "AMBIGUOUS") & F.col("strategy").startswith("fuzzy"), F.lit(False)))


def common_labels(values: DataFrame, least: int = 2) -> DataFrame:
    """Per group the labels with a number in at least ``least`` products, from (group_id, product_id, label, number)."""
    per = values.where("number is not null").groupBy("group_id", "label").agg(F.count_distinct("product_id").alias("products"))
    return per.where(F.col("products") >= least)


def benchmark_groups(scores: DataFrame) -> DataFrame:
    """Scores (name, version, kind, score) by claim: how many, and their range."""
    return scores.groupBy("name", "version", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


def wanted_keys(allowed: Column, present: Column, asked: Column) -> Column:
    """Keys to look for: allowed, asked for (all, if none is), and not there yet."""
    open_ = F.array_except(allowed, present)
    return F.array_sort(F.when(F.size(asked) > 0, F.array_intersect(open_, asked)).otherwise(open_))


def shared_values(a: Column, b: Column) -> Column:
    """Per unit that two lists of (value, unit) share, whether they share a value of it."""
    units = lambda c: F.transform(c, lambda p: p["unit"])
    both = F.array_sort(F.array_distinct(F.array_intersect(units(a), units(b))))
    of = lambda c, u: F.transform(F.filter(c, lambda p: p["unit"] == u), lambda p: p["value"])
    return F.transform(both, lambda u: F.struct(u.alias("unit"), F.arrays_overlap(of(a, u), of(b, u)).alias("same")))


def mentions(messages: DataFrame, dictionary: DataFrame, text_col: str = "text") -> DataFrame:
    """(message_id, kind, term) for the dictionary's terms (kind, term) that a message holds, without case and marks, inside words too."""
    said = messages.select("message_id", unmarked(F.coalesce(F.col(text_col), F.lit(""))).alias("said"))
    terms = dictionary.select("kind", F.col("term").alias("_own"), unmarked(F.col("term")).alias("term"))
    found = held(said, terms, text_col="said", keep=["message_id"])
    return found.join(terms, "term").select("message_id", "kind", F.col("_own").alias("term")).distinct()


def unmatched(mentioned: DataFrame, known: DataFrame) -> DataFrame:
    """Mentions (message_id, term) that the catalogue lacks: no product name or brand (name, brand) holds them or is held by them."""
    names = known.select("name") if "brand" not in known.columns else known.select(F.explode(F.array("name", "brand")).alias("name"))
    return absent(mentioned, names)
