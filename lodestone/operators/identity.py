"""Which product an offer is of: a ladder of identity keys, then candidates of similar names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import brand_key, gtin, model_key, mpn_forms, sku_key
from lodestone.operators.names import similar_names
from lodestone.tables import written

#: Strategies in the order they are asked, with their confidence.
LADDER = (("gtin", 1.0), ("mpn_brand", 0.95), ("manufacturer_sku", 0.9), ("brand_model", 0.85))
HIGH, MEDIUM = 0.92, 0.8


def keyed(df: DataFrame) -> DataFrame:
    """Adds the normal form of each identity column: gtin, brand, mpn, model, sku."""
    return df.withColumns({"k_gtin": gtin(F.col("gtin")), "k_brand": brand_key(F.col("brand")), "k_model": model_key(F.col("model")), "k_sku": sku_key(F.col("sku")), "k_mpn": mpn_forms(F.col("mpn"))})


def mpn_pairs(offers: DataFrame, products: DataFrame) -> DataFrame:
    """(offer_id, product_id) of one brand that have a form of the part number in common: an equi-join of the exploded forms."""
    left = keyed(offers).select("offer_id", F.lower("brand").alias("b"), F.explode("k_mpn").alias("form"))
    right = keyed(products).select("product_id", F.lower("brand").alias("b"), F.explode("k_mpn").alias("form"))
    return left.join(right, ["b", "form"]).select("offer_id", "product_id").distinct()


def strategy_ends(offers: DataFrame, products: DataFrame) -> DataFrame:
    """(offer_id, rung, least, most): the smallest and the greatest product that each strategy finds for an offer; there are several if they differ.

    Products shrink to a row for each key before they meet the offers, so a key that many of both have makes no pairs of them.
    """
    o, p = keyed(offers), keyed(products)
    ends = (F.min("product_id").alias("least"), F.max("product_id").alias("most"))

    def by(left: DataFrame, right: DataFrame, rung: int, *keys: str) -> DataFrame:
        few = right.groupBy(*keys).agg(*ends)
        return left.select("offer_id", *keys).join(few, list(keys)).select("offer_id", F.lit(rung).alias("rung"), "least", "most")

    low = lambda df: df.withColumns({"b": F.lower("brand"), "m": F.lower("model")})
    forms = lambda df: low(df).withColumn("form", F.explode("k_mpn"))
    # A number that is only digits says nothing unless the store vouches for it; others need letters and digits.
    telling = F.when(F.col("k_sku").rlike("^[0-9]+$"), F.col("sku_is_identity")).otherwise(F.col("k_sku").rlike("[A-Z]") & F.col("k_sku").rlike("[0-9]"))
    told = low(o.where(telling))
    found = (
        by(o, p, 0, "k_gtin"), by(forms(o), forms(p), 1, "b", "form"), by(told, low(p), 2, "k_sku", "b"), by(told.where("b is null"), p, 2, "k_sku"),
        by(low(o.where("k_brand is not null and k_model is not null")), low(p), 3, "b", "m"),
    )
    return reduce(DataFrame.unionByName, found).groupBy("offer_id", "rung").agg(F.min("least").alias("least"), F.max("most").alias("most"))


def match(offers: DataFrame, products: DataFrame) -> DataFrame:
    """Each offer's status, strategy, confidence and product. Several products by part number or model are ambiguous; elsewhere the smallest id counts."""
    found = strategy_ends(offers, products).withColumnRenamed("least", "product_id")
    best = found.groupBy("offer_id").agg(F.min(F.struct("rung", "product_id", "most")).alias("best"))
    met = offers.select("offer_id").join(best, "offer_id", "left")
    vague = (F.col("best.product_id") < F.col("best.most")) & F.col("best.rung").isin(1, 3)
    rungs = F.array(*[F.lit(name) for name, _ in LADDER])
    weights = F.array(*[F.lit(w) for _, w in LADDER])
    status = F.when(F.col("best").isNull(), "NO_MATCH").when(vague, "AMBIGUOUS").otherwise("MATCH")
    at = F.col("best.rung") + 1
    return met.select("offer_id", status.alias("status"), F.when(F.col("best").isNotNull(), F.element_at(rungs, at)).alias("strategy"), F.when(F.col("best").isNotNull(), F.element_at(weights, at)).alias("confidence"), F.when(~F.coalesce(vague, F.lit(True)), F.col("best.product_id")).alias("product_id"))


def conflicts(offers: DataFrame, products: DataFrame) -> DataFrame:
    """Offers whose GTIN and part number lead to different products."""
    ends = strategy_ends(offers, products).where("rung < 2")
    sides = ends.groupBy("offer_id").agg(F.min(F.when(F.col("rung") == 0, F.col("least"))).alias("by_gtin"), F.min(F.when(F.col("rung") == 1, F.col("least"))).alias("by_mpn"))
    return sides.where("by_gtin <> by_mpn")


def candidates(offers: DataFrame, products: DataFrame, *, least: float = MEDIUM, top: int = 5) -> DataFrame:
    """The most similar names within the offer's brand.

    Each pair of different names that may be similar enough is compared once, however many rows bear them. Of a
    product name only the ``top`` smallest ids can be in a list.
    """
    left = offers.select("offer_id", F.lower("brand").alias("b"), F.lower("name").alias("offer_name"))
    right = products.select("product_id", F.lower("brand").alias("b"), F.lower("name").alias("product_name"))
    first = Window.partitionBy("b", "product_name").orderBy("product_id")
    few = right.withColumn("n", F.row_number().over(first)).where(F.col("n") <= top).drop("n")
    grouped = lambda df, name: df.select(F.col("b").alias("group"), F.col(name).alias("name"))
    close = similar_names(grouped(left, "offer_name"), grouped(right, "product_name"), least)
    close = close.select(F.col("group").alias("b"), F.col("a").alias("offer_name"), F.col("b").alias("product_name"), "score")
    order = Window.partitionBy("b", "offer_name").orderBy(F.desc("score"), "product_id")
    lists = close.join(few, ["b", "product_name"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    level = F.when(F.col("score") >= HIGH, "fuzzy_high").otherwise("fuzzy_medium")
    named = left.join(lists, ["b", "offer_name"])
    return named.select("offer_id", "product_id", F.round("score", 6).alias("score"), level.alias("level"), "rank")


def match_or_similar(offers: DataFrame, products: DataFrame, *, least: float = MEDIUM, top: int = 5) -> DataFrame:
    """The whole ladder: match(), and for offers that no key finds the similar names as a last rung. That one is never sure:
    the offer is ambiguous, with the strategy and score of its best candidate and the ids of all."""
    keyed_ = written(match(offers, products), "keyed-matches")
    open_ = offers.join(keyed_.where("status = 'NO_MATCH'").select("offer_id"), "offer_id", "left_semi")
    found = candidates(open_, products, least=least, top=top)
    lists = found.groupBy("offer_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "product_id"))), lambda x: x["product_id"]).alias("candidates"),
        F.min_by("level", "rank").alias("level"), F.max("score").alias("score"),
    )
    met = keyed_.join(lists, "offer_id", "left")
    fuzzy = F.col("candidates").isNotNull()
    return met.select(
        "offer_id", F.when(fuzzy, "AMBIGUOUS").otherwise(F.col("status")).alias("status"), F.coalesce("level", "strategy").alias("strategy"),
        F.coalesce("score", "confidence").alias("confidence"), "product_id", "candidates",
    )


def confidence_policy(answers: DataFrame) -> DataFrame:
    """What a model's answer (status, confidence, product_id, candidate_ids) amounts to: kept from 0.95, made ambiguous from 0.7, else no match; never a product outside the candidates."""
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    known = F.array_contains("candidate_ids", F.col("product_id"))
    status = F.when((F.col("status") == "MATCH") & ~F.coalesce(known, F.lit(False)), "NO_MATCH").when(sure >= 0.95, F.col("status")).when((sure >= 0.7) & (F.col("status") == "MATCH"), "AMBIGUOUS").otherwise("NO_MATCH")
    return answers.withColumn("status", status).withColumn("confidence", sure).withColumn("product_id", F.when(F.col("status") == "MATCH", F.col("product_id")))
