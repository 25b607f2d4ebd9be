"""Store connectors, merging of offers, alerts of users, and settling values by hand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import blank_to_null, condition

# Which of a page's keys names an offer in each kind of store, in order.
EXTERNAL_ID = {"paris": ("sku", "product_id"), "spdigital": ("product_id", "sku")}
UNNAMED, CURRENCY = "Sin nombre", "CLP"


def external_id(kind: str) -> Column:
    """The first of the store's keys, else brand:mpn."""
    pair = F.when((F.length("brand") > 0) & (F.length("mpn") > 0), F.concat_ws(":", "brand", "mpn"))
    return F.coalesce(*[blank_to_null(F.col(c)) for c in EXTERNAL_ID[kind]], pair)


def connected(pages: DataFrame, registry: DataFrame, domain_col: str = "domain") -> DataFrame:
    """Adds the ``kind`` of the connector that a page's domain, or the domain above it, is registered for (domain, kind); null without one."""
    known = registry.select(F.lower("domain").alias("_d"), "kind")
    parent = F.regexp_replace(F.lower(domain_col), r"^[^.]+\.(?=[^.]+\.)", "")
    own = pages.withColumns({"_own": F.lower(domain_col), "_up": parent})
    exact = own.join(known.withColumnsRenamed({"kind": "_k1", "_d": "_d1"}), F.col("_own") == F.col("_d1"), "left")
    met = exact.join(known.withColumnsRenamed({"kind": "_k2", "_d": "_d2"}), F.col("_up") == F.col("_d2"), "left")
    return met.select(*pages.columns, F.coalesce("_k1", "_k2").alias("kind"))


def normal_offers(pages: DataFrame) -> DataFrame:
    """Pages (kind, url, name, brand, mpn, sku, product_id, price, currency, availability, condition) with a connector as offers, with what a page leaves out filled in."""
    ids = reduce(lambda chain, kind: chain.when(F.col("kind") == kind, external_id(kind)), list(EXTERNAL_ID)[1:], F.when(F.col("kind") == list(EXTERNAL_ID)[0], external_id(list(EXTERNAL_ID)[0])))
    sold = F.when(F.col("availability"), "in_stock").when(~F.col("availability"), "out_of_stock").otherwise("unknown")
    return pages.where("kind is not null").select(
        F.col("kind").alias("source"), ids.alias("external_id"), "url", F.coalesce(blank_to_null(F.col("name")), F.lit(UNNAMED)).alias("name"), "brand",
        F.coalesce("price", F.lit(0)).alias("price"), F.upper(F.coalesce("currency", F.lit(CURRENCY))).alias("currency"), F.coalesce("availability", F.lit(True)).alias("available"),
        sold.alias("stock"), condition(F.col("condition")).alias("condition"),
    )


def merged_offers(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Offers (offer_id, store_id, external_id, url, price) after one batch (store_id, external_id, url, price, each offer once): offer_id, store_id, external_id, url, price, outcome.

    An offer is found by (store, external id), else by (store, url). It takes the new address unless another offer of its store has that,
    which keeps the old one. Outcomes: created (no offer_id yet), price_changed, unchanged, untouched. Joins on equal keys only.
    """
    old = current.select(*[F.col(c).alias(f"_{c}") for c in ("offer_id", "store_id", "external_id", "url", "price")])
    rows = incoming.select("store_id", "external_id", "url", F.col("price").alias("price"))
    by_id = old.where("_external_id is not null").groupBy("_store_id", "_external_id").agg(F.min("_offer_id").alias("_by_id"))
    by_url = old.groupBy(F.col("_store_id").alias("_s2"), F.col("_url").alias("_u2")).agg(F.min("_offer_id").alias("_by_url"))
    found = rows.join(by_id, (F.col("store_id") == F.col("_store_id")) & (F.col("external_id") == F.col("_external_id")), "left").drop("_store_id", "_external_id")
    found = found.join(by_url, (F.col("store_id") == F.col("_s2")) & (F.col("url") == F.col("_u2")), "left").drop("_s2", "_u2").withColumn("_at", F.coalesce("_by_id", "_by_url"))
    met = found.join(old, F.col("_at") == F.col("_offer_id"), "left")
    taken = F.col("_by_url").isNotNull() & (F.col("_by_url") != F.col("_at"))
    outcome = F.when(F.col("_at").isNull(), "created").when(F.col("_price") != F.col("price"), "price_changed").otherwise("unchanged")
    fresh = met.select(F.col("_at").alias("offer_id"), "store_id", "external_id", F.when(taken, F.col("_url")).otherwise(F.col("url")).alias("url"), "price", outcome.alias("outcome"))
    rest = old.join(found.where("_at is not null").select(F.col("_at").alias("_offer_id")), "_offer_id", "left_anti")
    return fresh.unionByName(rest.select(*[F.col(f"_{c}").alias(c) for c in ("offer_id", "store_id", "external_id", "url", "price")], F.lit("untouched").alias("outcome")))


def upserted_alerts(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Alerts (user_id, product_id, target, active) after requests in order (user_id, product_id, target, seq): the last request of a user for a product sets the target and makes the alert active; there is one for each pair."""
    last = incoming.groupBy(F.col("user_id").alias("_u"), F.col("product_id").alias("_p")).agg(F.max(F.struct("seq", "target"))["target"].alias("_target"))
    met = current.join(last, (F.col("user_id") == F.col("_u")) & (F.col("product_id") == F.col("_p")), "full_outer")
    return met.select(F.coalesce("user_id", "_u").alias("user_id"), F.coalesce("product_id", "_p").alias("product_id"), F.coalesce("_target", "target").alias("target"), (F.col("_target").isNotNull() | F.coalesce("active", F.lit(False))).alias("active"))


def reached(alerts: DataFrame, best: DataFrame) -> DataFrame:
    """Active alerts with the best current price (product_id, price) of their product, and whether it is at or under the target; unavailable products have none."""
    now = best.select(F.col("product_id").alias("_p"), F.col("price").alias("current_price"))
    met = alerts.where("active").join(now, F.col("product_id") == F.col("_p"), "left")
    return met.select("user_id", "product_id", "target", "current_price", F.coalesce(F.col("current_price") <= F.col("target"), F.lit(False)).alias("reached"))


def verified_by_hand(states: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """States (product_id, definition_id, value, verification, conflict) after an editor's decisions on some (product_id, definition_id, value or null for what stands), and the history rows of these."""
    made = decisions.select(F.col("product_id").alias("_p"), F.col("definition_id").alias("_d"), F.col("value").alias("_value"), F.lit(True).alias("_hit"))
    met = states.join(made, (F.col("product_id") == F.col("_p")) & (F.col("definition_id") == F.col("_d")), "left")
    settled = lambda new, old: F.when(F.col("_hit"), new).otherwise(F.col(old)).alias(old)
    after = met.select("product_id", "definition_id", F.coalesce("_value", "value").alias("value"), settled("verified", "verification"), settled("resolved", "conflict"))
    history = met.where("_hit").select("product_id", "definition_id", F.col("value").alias("old_value"), F.coalesce("_value", "value").alias("new_value"), F.lit("verified").alias("action"))
    return after, history


def value_status(values: DataFrame, expected: DataFrame) -> DataFrame:
    """Per product of ``expected`` (product_id): missing without values, conflict if one is pending, verified if all are, else unverified. values: product_id, verification, conflict."""
    per = values.groupBy(F.col("product_id").alias("_p")).agg(F.count_if(F.col("conflict") == "pending").alias("pending"), F.every(F.col("verification") == "verified").alias("all"))
    status = F.when(F.col("_p").isNull(), "missing").when(F.col("pending") > 0, "conflict").when(F.col("all"), "verified").otherwise("unverified")
    return expected.join(per, F.col("product_id") == F.col("_p"), "left").select("product_id", status.alias("status"))


def best_worded(values: DataFrame) -> DataFrame:
    """One value for each (product_id, key) of rows (source, value, place): a manufacturer's, else the longest; the first of equals."""
    order = F.struct((F.col("source") == "manufacturer").alias("own"), F.length("value").alias("n"), (-F.col("place")).alias("first"), "value")
    return values.groupBy("product_id", "key").agg(F.max(order)["value"].alias("value"))


def snapshot(alerts: DataFrame, best: DataFrame, items: DataFrame, memories: DataFrame, most: int = 5) -> DataFrame:
    """One row for each user of any of them: active alerts reached and in all, list items, and the newest memories (user_id, memory_id, content)."""
    watched = reached(alerts, best).groupBy("user_id").agg(F.count(F.lit(1)).alias("alerts"), F.count_if("reached").alias("reached"))
    listed = items.groupBy("user_id").agg(F.count_distinct("product_id").alias("items"))
    newest = memories.withColumn("_n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("memory_id")))).where(F.col("_n") <= most)
    told = newest.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "content"))), lambda m: m["content"]), " | ").alias("memories"))
    met = watched.join(listed, "user_id", "full_outer").join(told, "user_id", "full_outer")
    return met.select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("alerts", "reached", "items")], F.coalesce("memories", F.lit("")).alias("memories"))


def wanted_urls(urls: DataFrame, *, prefixes: tuple[str, ...] = (), parts: tuple[str, ...] = (), keywords: tuple[str, ...] = ()) -> DataFrame:
    """Addresses (url) that begin with none of the prefixes, hold none of the parts, and hold some keyword, if there are any."""
    low = F.lower("url")
    out = [F.col("url").startswith(p) for p in prefixes] + [F.col("url").contains(p) for p in parts]
    some = reduce(Column.__or__, [low.contains(k.lower()) for k in keywords]) if keywords else F.lit(True)
    return urls.where(~reduce(Column.__or__, out, F.lit(False)) & some)


def run_report(outcomes: DataFrame) -> DataFrame:
    """Counters of an ingestion run over rows (outcome, error): processed, created, price_changed, unchanged, rejected, failed, other; price changes leave new offers out."""
    count = lambda name: F.count_if(F.col("error").isNull() & (F.col("outcome") == name)).alias(name)
    known = ("created", "price_changed", "unchanged", "rejected")
    other = F.count_if(F.col("error").isNull() & ~F.coalesce(F.col("outcome").isin(*known), F.lit(False))).alias("other")
    return outcomes.agg(F.count(F.lit(1)).alias("processed"), *map(count, known), F.count_if(F.col("error").isNotNull()).alias("failed"), other)
