"""Validation, eligibility and merging of incoming offers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.urls import normal_url

# Words that mark bundles, services and gift cards, and the conditions of an article.
BUNDLES = ("bundle", "bulto", "pack", "combo", "kit", "set", "lote", "2 en 1", "3 en 1", "4 en 1", "5 en 1", "regalo", "obsequio")
SERVICES = ("servicio", "service", "suscripción", "subscription", "garantía", "warranty", "garant estendida", "seguro", "plan", "mantención")
GIFT_CARDS = ("gift card", "tarjeta de regalo", "vale", "voucher", "crédito", "saldo")
CONDITIONS = ("new", "open_box", "refurbished", "semi_new", "used", "unknown")


def reject_reason(offer_cols: dict[str, Column] | None = None) -> Column:
    """Why an offer is not taken; null if it is. Rules in order."""
    c = {n: F.col(n) for n in ("source", "name", "product_url", "price", "currency", "condition")} | (offer_cols or {})
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    return (
        F.when(blank(c["source"]) | blank(c["name"]), "source_or_name_missing")
        .when(~F.coalesce(c["product_url"].rlike("(?i)^https?:"), F.lit(False)), "url_not_http")
        .when(F.coalesce(c["price"], F.lit(0)) <= 0, "price_not_positive")
        .when(~F.coalesce(c["currency"].rlike("^[A-Za-z]{3}$"), F.lit(False)), "currency_not_iso")
        .when(~F.coalesce(c["condition"].isin(*CONDITIONS), F.lit(False)), "condition_unknown")
        .when(c["price"] % 1 != 0, "price_has_fraction")
    )


def eligibility(name: Column, url: Column, price: Column, category: Column, identity: Column) -> Column:
    """Why an offer is not eligible; null if it is. Words are looked for anywhere in the name, also inside other words."""
    has = lambda words: reduce(Column.__or__, [F.lower(name).contains(w) for w in words])
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    return (
        F.when(blank(category), "missing_category").when(blank(name), "missing_name").when(blank(url), "missing_url").when(F.coalesce(price, F.lit(0)) <= 0, "invalid_price")
        .when(blank(identity), "missing_product_identity").when(has(BUNDLES), "is_bundle").when(has(SERVICES), "is_service").when(has(GIFT_CARDS), "is_service")
    )


def first_by_url(pages: DataFrame, url_col: str = "url", order: str = "page_id") -> DataFrame:
    """The first page of each normal address; how many addresses it stands for comes along."""
    least = pages.withColumn("normal", normal_url(F.col(url_col))).groupBy("normal").agg(F.min(F.struct(order, url_col)).alias("one"), F.count(F.lit(1)).alias("n"))
    return least.select(F.col(f"one.{order}").alias(order), F.col(f"one.{url_col}").alias(url_col), "normal", "n")


def merge_offers(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The offers (product_id, store_id, price, available, observed_at) after a batch: the batch's last row of each key replaces the old one."""
    moment = F.struct("observed_at", "order_id", "line_no", "price", "available")
    last = incoming.groupBy("product_id", "store_id").agg(F.max(moment).alias("new"))
    met = current.join(last, ["product_id", "store_id"], "full_outer")
    take = lambda c: F.coalesce(F.col(f"new.{c}"), F.col(c)).alias(c)
    change = F.when(F.col("new").isNull(), "kept").when(F.col("price").isNull(), "created").when(F.col("price") != F.col("new.price"), "price_changed").otherwise("updated")
    return met.select("product_id", "store_id", take("price"), take("available"), take("observed_at"), change.alias("change"))


def first_documents(docs: DataFrame) -> DataFrame:
    """Documents by content: of equal cleaned texts (white space collapsed) the first stays."""
    clean = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \t\n\r]+", " "))
    hashed = docs.select("doc_id", F.sha2(clean, 256).alias("content_hash"), F.greatest(F.lit(1), F.bround(F.length(clean) / 4.0).cast("int")).alias("approx_tokens"))
    return hashed.groupBy("content_hash").agg(F.min(F.struct("doc_id", "approx_tokens")).alias("one"), F.count(F.lit(1)).alias("copies")).select("one.doc_id", "content_hash", "one.approx_tokens", "copies")


def report(observations: DataFrame) -> DataFrame:
    """Counts of one ingestion run over observations in order: processed, created, price changes (first prices left out), unchanged."""
    order = Window.partitionBy("product_id", "store_id").orderBy("observed_at", "order_id", "line_no")
    seen = observations.withColumn("previous", F.lag("price").over(order))
    count = lambda cond, name: F.count_if(cond).alias(name)
    return seen.agg(F.count(F.lit(1)).alias("processed"), count(F.col("previous").isNull(), "created"), count(F.col("previous") != F.col("price"), "price_changes"), count(F.col("previous") == F.col("price"), "unchanged"))


def run_status(errors: Column, outcomes: Column) -> Column:
    return F.when((errors > 0) & (outcomes == 0), "error").when(errors == 0, "success").otherwise("partial")


# Words in a path that mark bundles, services and gift cards before a page is fetched.
URL_BUNDLES = ("bundle", "bulto", "pack", "combo", "kit", "set", "lote", "regalo", "obsequio", "gift")
URL_SERVICES = ("servicio", "service", "suscripcion", "subscription", "garantia", "warranty", "seguro", "plan", "mantencion", "soporte", "instalacion", "configuracion")
URL_GIFT_CARDS = ("gift-card", "tarjeta-de-regalo", "vale", "voucher", "credito", "saldo")


def url_eligibility(url: Column) -> Column:
    """Why a page is not worth fetching, by its address alone; null if it is."""
    path = F.lower(F.coalesce(F.try_parse_url(F.trim(url), F.lit("PATH")), F.lit("")))
    has = lambda words: reduce(Column.__or__, [path.contains(w) for w in words])
    usable = F.coalesce(F.trim(url).rlike("(?i)^https?://"), F.lit(False))
    return F.when(~usable, "missing_url").when(has(URL_BUNDLES), "is_bundle").when(has(URL_SERVICES) | has(URL_GIFT_CARDS), "is_service")


def category_verdict(offers: DataFrame, taxonomy: DataFrame, *, priorities: tuple[str, ...] = ("P0", "P1", "P2"), blacklist: tuple[str, ...] = (), whitelist: tuple[str, ...] | None = None) -> DataFrame:
    """Adds ``category_reason`` (null: allowed) by the taxonomy's slug, is_group and priority."""
    node = taxonomy.select(F.col("slug").alias("_slug"), "is_group", "priority")
    met = offers.join(node, F.col("category_slug") == F.col("_slug"), "left")
    outside = ~F.col("_slug").isin(*whitelist) if whitelist is not None else F.lit(False)
    reason = F.when(F.col("_slug").isNull(), "unknown_category").when(F.col("is_group"), "is_group_node").when(F.col("_slug").isin(*blacklist), "blacklisted").when(outside | ~F.col("priority").isin(*priorities), "not_in_whitelist")
    return met.withColumn("category_reason", reason).drop("_slug", "is_group", "priority")


def mapped_categories(offers: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds ``category_slug`` by the store's own name of the category, trimmed and in lower case."""
    known = mapping.select(F.lower(F.trim("store_category")).alias("_k"), "category_slug").dropDuplicates(["_k"])
    return offers.join(known, F.lower(F.trim("store_category")) == F.col("_k"), "left").drop("_k")
