"""Upkeep of the catalogue: seeding, merging, moving and guarded deletion, each as a new snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seeded(tree: DataFrame, canonical: DataFrame) -> DataFrame:
    """The tree (slug, name, parent) after a canonical one was merged in by slug: its names and parents win, slugs it lacks stay."""
    c = canonical.select("slug", F.col("name").alias("c_name"), F.col("parent").alias("c_parent"), F.lit(True).alias("c"))
    met = tree.join(c, "slug", "full_outer")
    change = F.when(F.col("c").isNull(), "kept").when(F.col("name").isNull(), "created").otherwise("updated")
    return met.select("slug", F.coalesce("c_name", "name").alias("name"), F.when(F.col("c"), F.col("c_parent")).otherwise(F.col("parent")).alias("parent"), change.alias("change"))


def obsolete(tree: DataFrame, canonical: DataFrame, members: DataFrame) -> DataFrame:
    """Slugs that may go: not canonical, without children and without members (slug)."""
    parents = tree.where("parent is not null").select(F.col("parent").alias("slug"))
    return tree.join(canonical.select("slug"), "slug", "left_anti").join(parents, "slug", "left_anti").join(members.select("slug"), "slug", "left_anti").select("slug")


def relinked(offers: DataFrame, moves: DataFrame) -> DataFrame:
    """Offers after products were merged: product ids of ``moves`` (old_id, new_id) are replaced."""
    met = offers.join(moves, F.col("product_id") == F.col("old_id"), "left")
    return met.select(*[F.coalesce("new_id", "product_id").alias(c) if c == "product_id" else F.col(c) for c in offers.columns])


def orphans(products: DataFrame, offers: DataFrame) -> DataFrame:
    return products.join(offers.select(F.col("product_id").alias("id")), "id", "left_anti")


def guarded_delete(df: DataFrame, ids: DataFrame, key: str, expected: int) -> DataFrame:
    """The frame without the ids, if exactly as many rows go as expected; else an error and nothing changes."""
    gone = df.join(ids.select(key).distinct(), key, "left_semi").count()
    if gone != expected:
        raise ValueError(f"{gone} rows would go, not {expected}")
    return df.join(ids.select(key), key, "left_anti")


def filled(old: DataFrame, new: DataFrame, key: str, *cols: str) -> DataFrame:
    """Blanks of the old rows filled from the new ones; what is there stays."""
    fresh = new.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in cols])
    met = old.join(fresh, F.col(key) == F.col("_k"), "left")
    return met.select(*[F.coalesce(F.when(F.trim(c) != "", F.col(c)), F.col(f"_{c}")).alias(c) if c in cols else F.col(c) for c in old.columns])


def migrated(legacy: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Legacy products (id, name, category, price) as categories, products and first offers."""
    categories = legacy.where("category is not null").groupBy("category").agg(F.min("id").alias("first_product"))
    offers = legacy.where("price is not null").select(F.col("id").alias("product_id"), F.lit(0).cast("bigint").alias("store_id"), "price")
    return categories, legacy.select("id", "name", "category"), offers


def dropped_price(products: DataFrame, offers: DataFrame, like: str, price: int) -> DataFrame:
    """Offers after those of products whose name is like a pattern were set to a price; ``old_min`` holds their product's least price before."""
    hit = products.where(F.col("name").ilike(like)).select(F.col("id").alias("_id"))
    least = offers.join(hit, F.col("product_id") == F.col("_id"), "left_semi").groupBy(F.col("product_id").alias("_p")).agg(F.min("price").alias("old_min"))
    met = offers.join(least, F.col("product_id") == F.col("_p"), "left")
    return met.select("product_id", "store_id", F.when(F.col("old_min").isNotNull(), price).otherwise(F.col("price")).cast("bigint").alias("price"), "old_min")


def failures(current: DataFrame, errors: DataFrame) -> DataFrame:
    """Offers' status and count of failures after errors came in for some: one more for each, status error."""
    n = errors.groupBy(F.col("offer_id").alias("_o")).agg(F.count(F.lit(1)).alias("_n"))
    met = current.join(n, F.col("offer_id") == F.col("_o"), "left")
    return met.select("offer_id", F.when(F.col("_n").isNotNull(), "error").otherwise(F.col("status")).alias("status"), (F.col("failures") + F.coalesce("_n", F.lit(0))).alias("failures"))


def filter_or_all(df: DataFrame, keep, *by: str) -> DataFrame:
    """Per group the rows that meet the condition; all of them where none does."""
    some = df.where(keep).select(*by).distinct()
    return df.where(keep).unionByName(df.join(some, list(by), "left_anti"))


def facts(products: DataFrame, offers: DataFrame, first: int = 3) -> DataFrame:
    """One line a product with its cheapest offers."""
    from lodestone.operators.prices import ranked_offers

    top = ranked_offers(offers, first).groupBy(F.col("product_id").alias("_p")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "store_id", "price"))), lambda o: F.concat_ws("=", o["store_id"], o["price"])), ", ").alias("offers"))
    return products.join(top, F.col("id") == F.col("_p"), "left").select("id", F.concat_ws("; ", "name", "brand", "offers").alias("sheet"))
