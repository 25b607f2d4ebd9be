"""Best offers, price histories, trends, alerts and baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOMENT = ("observed_at", "order_id", "line_no")


def best_offers(offers: DataFrame) -> DataFrame:
    """The cheapest available offer in CLP of each product; ties go to the smaller store. An aggregate, so a popular product is no hot group."""
    usable = offers.where((F.col("currency") == "CLP") & F.col("available"))
    best = usable.groupBy("product_id").agg(F.min(F.struct("price", "store_id")).alias("best"))
    return best.select("product_id", F.col("best.price").alias("price"), F.col("best.store_id").alias("store_id"))


def ranked_offers(offers: DataFrame, first: int) -> DataFrame:
    """The first offers of each product by price, and how many it has in all."""
    order = Window.partitionBy("product_id").orderBy("price", "store_id")
    top = offers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    totals = offers.groupBy("product_id").agg(F.count(F.lit(1)).alias("total"))
    return top.join(totals, "product_id").select("product_id", "store_id", "price", "rank", "total")


def price_cards(products: DataFrame, offers: DataFrame) -> DataFrame:
    """price_clp (0 without an offer that can be bought), category with a label for none, and the count of all offers."""
    counts = offers.groupBy(F.col("product_id").alias("_o")).agg(F.count(F.lit(1)).alias("n"))
    best = best_offers(offers).select(F.col("product_id").alias("_b"), "price")
    met = products.join(counts, F.col("id") == F.col("_o"), "left").join(best, F.col("id") == F.col("_b"), "left")
    return met.select("id", F.coalesce("category", F.lit("Sin categoría")).alias("category"), F.coalesce("price", F.lit(0)).alias("price_clp"), F.coalesce("n", F.lit(0)).alias("offer_count"))


def history_tail(observations: DataFrame, last: int) -> DataFrame:
    """The last observations of each product, numbered from the oldest of them."""
    back = Window.partitionBy("product_id").orderBy(*[F.desc(c) for c in MOMENT])
    tail = observations.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= last)
    size = F.count(F.lit(1)).over(Window.partitionBy("product_id"))
    return tail.withColumn("position", (size - F.col("_back") + 1).cast("int")).drop("_back")


def changes(observations: DataFrame) -> DataFrame:
    """The first price of each offer, and each that differs from the one before; other changes add nothing."""
    order = Window.partitionBy("product_id", "store_id").orderBy(*MOMENT)
    seen = observations.withColumn("previous", F.lag("price").over(order))
    return seen.where("previous is null or previous <> price")


def change_pct(observations: DataFrame) -> DataFrame:
    """Least, greatest, and the change from the first to the last price in percent; 0 if the first price is 0."""
    moment = F.struct(*MOMENT)
    out = observations.groupBy("product_id").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.min(F.struct(moment, "price"))["price"].alias("first_price"), F.max(F.struct(moment, "price"))["price"].alias("last_price"))
    change = F.when(F.col("first_price") == 0, 0.0).otherwise((F.col("last_price") - F.col("first_price")) / F.col("first_price") * 100)
    return out.withColumn("change_pct", change)


def trends(observations: DataFrame, current: DataFrame) -> DataFrame:
    """A verdict for each product from its history and its current price (product_id, price)."""
    real = F.when(F.col("price") != 0, F.col("price"))
    stats = observations.groupBy(F.col("product_id").alias("_p")).agg(F.count(real).alias("points"), F.min(real).alias("low"), F.max(real).alias("high"), F.bround(F.sum(real).cast("double") / F.count(real)).cast("bigint").alias("mean"))
    met = stats.join(current.select("product_id", F.col("price").alias("current")), F.col("_p") == F.col("product_id"), "left")
    verdict = (
        F.when(F.col("current").isNull(), "sin_precio_actual")
        .when(F.col("points") < 3, "sin_historial_suficiente")
        .when(F.col("current") <= F.col("low") * F.lit(1.03), "buen_momento")
        .when(F.col("current") >= F.col("mean") * F.lit(1.05), "esperar")
        .otherwise("precio_normal")
    )
    return met.select(F.col("_p").alias("product_id"), "points", "low", "high", "mean", "current", verdict.alias("verdict"))


def alerts(targets: DataFrame, observations: DataFrame) -> DataFrame:
    """When each alert (alert_id, product_id, target) first fires; null if it never does.

    Observations shrink to the first moment of each price, and of these to the steps down in price at which no lower price
    was seen earlier: nothing else can be the first to reach a target.
    """
    firsts = observations.where("available").groupBy(F.col("product_id").alias("_p"), "price").agg(F.min("observed_at").alias("at"))
    below = Window.partitionBy("_p").orderBy("price").rowsBetween(Window.unboundedPreceding, -1)
    steps = firsts.withColumn("_earlier", F.min("at").over(below)).where("_earlier is null or at < _earlier")
    hits = targets.join(steps, (F.col("product_id") == F.col("_p")) & (F.col("price") <= F.col("target")))
    first = hits.groupBy("alert_id").agg(F.min("at").alias("fired_at"))
    return targets.join(first, "alert_id", "left")


def basket(items: DataFrame, offers: DataFrame, budget: int) -> DataFrame:
    """Per list: the different products that can be bought, their total at best prices, and whether it is within the budget. items: list_id, product_id."""
    met = items.distinct().join(best_offers(offers), "product_id", "left").groupBy("list_id").agg(F.count("price").alias("available"), F.count(F.lit(1)).alias("wanted"), F.coalesce(F.sum("price"), F.lit(0)).alias("total"))
    return met.withColumn("within_budget", F.col("total") <= budget)


def discount_pct(old, new):
    """Whole percent off, halves rounded up; null if there is none."""
    pct = F.floor((old - new) / old * 100 + 0.5).cast("bigint")
    return F.when((old > 0) & (pct > 0), pct)
