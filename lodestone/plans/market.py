"""Queries of connectors, offers, alerts and values settled by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import bindings as b
from lodestone.bindings import with_views
from lodestone.operators import market as m
from lodestone.registry import query

_REGISTRY = "SELECT * FROM (VALUES ('example.com', 'paris'), ('example.net', 'spdigital')) AS r(domain, kind)"
_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1))"
_PAGE = (
    f"SELECT page_id, url, {_HOST} AS domain, CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS STRING) WHEN page_id % 3 = 1 THEN '' END AS sku, CASE WHEN page_id % 4 = 0 THEN concat('P', CAST(page_id AS STRING)) END AS product_id, "
    "CASE WHEN page_id % 5 > 0 THEN 'acme' END AS brand, CASE WHEN page_id % 7 > 0 THEN concat('M-', CAST(page_id AS STRING)) END AS mpn, CASE WHEN page_id % 6 > 0 THEN concat('thing ', CAST(page_id AS STRING)) END AS name, "
    "CASE WHEN page_id % 8 > 0 THEN page_id * 10 END AS price, CASE WHEN page_id % 9 = 0 THEN 'usd' END AS currency, CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS availability, CASE WHEN page_id % 2 = 0 THEN 'NewCondition' ELSE 'usado' END AS condition FROM {}"
)


def _pages(spark, sf_dir):
    pages = b.table(spark, sf_dir, "pages")
    return m.connected(spark.sql(_PAGE.format("{pages}"), pages=pages), spark.sql(_REGISTRY))


_KIND = f"WITH r AS ({_REGISTRY}), p AS ({_PAGE.format('pages')}), k AS (SELECT p.*, coalesce((SELECT kind FROM r WHERE r.domain = p.domain), (SELECT kind FROM r WHERE r.domain = regexp_replace(p.domain, '^[^.]+\\.([^.]+\\.)', '\\1'))) AS kind FROM p)"


@query(_KIND + " SELECT page_id, domain, kind FROM k")
def connector_registry(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "domain", "kind")


_PAIR = "CASE WHEN length(brand) > 0 AND length(mpn) > 0 THEN brand || ':' || mpn END"


@query(
    _KIND + f" SELECT kind AS source, CASE kind WHEN 'paris' THEN coalesce(nullif(sku, ''), nullif(product_id, ''), {_PAIR}) ELSE coalesce(nullif(product_id, ''), nullif(sku, ''), {_PAIR}) END AS external_id, url, coalesce(name, 'Sin nombre') AS name, brand, coalesce(price, 0) AS price, upper(coalesce(currency, 'CLP')) AS currency, "
    "coalesce(availability, true) AS available, CASE WHEN availability THEN 'in_stock' WHEN NOT availability THEN 'out_of_stock' ELSE 'unknown' END AS stock, CASE WHEN condition = 'usado' THEN 'used' ELSE 'new' END AS condition FROM k WHERE kind IS NOT NULL"
)
def normal_offers(spark, sf_dir):
    return m.normal_offers(_pages(spark, sf_dir))


_CURRENT = "SELECT s_suppkey * 10 + i AS offer_id, s_suppkey AS store_id, CASE WHEN i < 3 THEN concat('x', CAST(i AS STRING)) END AS external_id, concat('u', CAST(i AS STRING)) AS url, 100 + s_suppkey % 7 AS price FROM {} CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3)) AS n(i)) AS n"
_BATCH = "SELECT s_suppkey AS store_id, CASE WHEN s_suppkey % 4 = j THEN NULL ELSE concat('x', CAST(j + s_suppkey % 2 AS STRING)) END AS external_id, concat('u', CAST((j * 3 + s_suppkey) % 5 AS STRING)) AS url, 100 + (s_suppkey + j) % 7 AS price FROM {} CROSS JOIN (SELECT * FROM (VALUES (0), (1)) AS n(j)) AS n"


@query(
    f"WITH c AS ({_CURRENT.format('supplier')}), b AS ({_BATCH.format('supplier')}), f AS (SELECT b.*, (SELECT min(offer_id) FROM c WHERE c.store_id = b.store_id AND c.external_id = b.external_id) AS by_id, (SELECT min(offer_id) FROM c WHERE c.store_id = b.store_id AND c.url = b.url) AS by_url FROM b), g AS (SELECT *, coalesce(by_id, by_url) AS hit FROM f) "
    "SELECT hit AS offer_id, g.store_id, g.external_id, CASE WHEN by_url <> hit THEN c.url ELSE g.url END AS url, g.price, CASE WHEN hit IS NULL THEN 'created' WHEN c.price <> g.price THEN 'price_changed' ELSE 'unchanged' END AS outcome FROM g LEFT JOIN c ON c.offer_id = hit "
    "UNION ALL SELECT offer_id, store_id, external_id, url, price, 'untouched' FROM c WHERE offer_id NOT IN (SELECT hit FROM g WHERE hit IS NOT NULL)"
)
def offer_merge(spark, sf_dir):
    """Four offers of each store meet two new readings each, by external id or address, with addresses that clash."""
    suppliers = b.table(spark, sf_dir, "supplier")
    return m.merged_offers(spark.sql(_CURRENT.format("{t}"), t=suppliers), spark.sql(_BATCH.format("{t}"), t=suppliers))


_ALERTS = "SELECT user_id, event_id % 50 AS product_id, 900 + event_id % 40 AS target, event_id % 3 > 0 AS active FROM {} WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 50 ORDER BY event_id) = 1"
_ASKED = "SELECT user_id, event_id % 50 AS product_id, 1000 + event_id % 60 AS target, event_id AS seq FROM events WHERE event_type = 'view'"
_UPSERT = (
    f"a AS ({_ALERTS.format('events')}), q AS ({_ASKED}), l AS (SELECT user_id, product_id, arg_max(target, seq) AS target FROM q GROUP BY ALL), "
    "u AS (SELECT coalesce(a.user_id, l.user_id) AS user_id, coalesce(a.product_id, l.product_id) AS product_id, coalesce(l.target, a.target) AS target, l.target IS NOT NULL OR coalesce(a.active, false) AS active FROM a FULL JOIN l ON l.user_id = a.user_id AND l.product_id = a.product_id)"
)


def _alerts(spark, sf_dir):
    from pyspark.sql import Window

    events = b.table(spark, sf_dir, "events").withColumn("product_id", F.col("event_id") % 50)
    first = F.row_number().over(Window.partitionBy("user_id", "product_id").orderBy("event_id"))
    current = events.where("event_type = 'click'").withColumn("_n", first).where("_n = 1").select("user_id", "product_id", (900 + F.col("event_id") % 40).alias("target"), (F.col("event_id") % 3 > 0).alias("active"))
    asked = events.where("event_type = 'view'").select("user_id", "product_id", (1000 + F.col("event_id") % 60).alias("target"), F.col("event_id").alias("seq"))
    return m.upserted_alerts(current, asked)


@query(f"WITH {_UPSERT} SELECT * FROM u")
def alert_upsert(spark, sf_dir):
    return _alerts(spark, sf_dir)


_BEST = ", best AS (SELECT product_id, min(price) AS price FROM offers WHERE available GROUP BY 1), "


@query(with_views("offers") + _BEST + _UPSERT + " SELECT user_id, u.product_id, target, price AS current_price, coalesce(price <= target, false) AS reached FROM u LEFT JOIN best ON best.product_id = u.product_id WHERE active")
def alerts_reached(spark, sf_dir):
    """Users' active alerts against the best offer that can be bought."""
    best = b.offers(spark, sf_dir).where("available").groupBy("product_id").agg(F.min("price").alias("price"))
    return m.reached(_alerts(spark, sf_dir), best)


@query(
    with_views("offers") + _BEST + _UPSERT + ", w AS (SELECT user_id, count(*) AS alerts, count(*) FILTER (WHERE price <= target) AS reached FROM u LEFT JOIN best ON best.product_id = u.product_id WHERE active GROUP BY 1), i AS (SELECT user_id, count(DISTINCT event_id % 50) AS items FROM events WHERE event_type = 'purchase' GROUP BY 1), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type = 'error'), t AS (SELECT user_id, string_agg(props, ' | ' ORDER BY n) AS memories FROM n WHERE n <= 5 GROUP BY 1) "
    "SELECT user_id, coalesce(alerts, 0) AS alerts, coalesce(reached, 0) AS reached, coalesce(items, 0) AS items, coalesce(memories, '') AS memories FROM w FULL JOIN i USING (user_id) FULL JOIN t USING (user_id)"
)
def user_snapshot(spark, sf_dir):
    """Alerts, purchases as list items, and the five last errors as memories of each user."""
    events = b.table(spark, sf_dir, "events")
    best = b.offers(spark, sf_dir).where("available").groupBy("product_id").agg(F.min("price").alias("price"))
    items = events.where("event_type = 'purchase'").select("user_id", (F.col("event_id") % 50).alias("product_id"))
    memories = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("memory_id"), F.col("props").alias("content"))
    return m.snapshot(_alerts(spark, sf_dir), best, items, memories)


_STATES = "SELECT p_partkey AS product_id, CAST(p_size % 3 AS STRING) AS definition_id, p_type AS value, CASE WHEN p_partkey % 4 = 0 THEN 'verified' ELSE 'auto' END AS verification, CASE WHEN p_partkey % 5 = 0 THEN 'pending' ELSE 'none' END AS conflict FROM {}"
_DECIDED = "SELECT p_partkey AS product_id, CAST(p_size % 3 AS STRING) AS definition_id, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS value FROM {} WHERE p_partkey % 7 = 0"


def _settled(spark, sf_dir):
    part = b.table(spark, sf_dir, "part")
    return m.verified_by_hand(spark.sql(_STATES.format("{t}"), t=part), spark.sql(_DECIDED.format("{t}"), t=part))


_HAND = f"WITH s AS ({_STATES.format('part')}), d AS ({_DECIDED.format('part')})"


@query(_HAND + " SELECT s.product_id, s.definition_id, coalesce(d.value, s.value) AS value, CASE WHEN d.product_id IS NOT NULL THEN 'verified' ELSE verification END AS verification, CASE WHEN d.product_id IS NOT NULL THEN 'resolved' ELSE conflict END AS conflict FROM s LEFT JOIN d ON d.product_id = s.product_id AND d.definition_id = s.definition_id")
def manual_verification(spark, sf_dir):
    return _settled(spark, sf_dir)[0]


@query(_HAND + " SELECT s.product_id, s.definition_id, s.value AS old_value, coalesce(d.value, s.value) AS new_value, 'verified' AS action FROM s JOIN d ON d.product_id = s.product_id AND d.definition_id = s.definition_id")
def manual_history(spark, sf_dir):
    return _settled(spark, sf_dir)[1]


@query(f"WITH s AS ({_STATES.format('part')} WHERE p_partkey % 6 > 0), x AS (SELECT product_id, count(*) FILTER (WHERE conflict = 'pending') AS pending, bool_and(verification = 'verified') AS ok FROM s GROUP BY 1) SELECT p_partkey AS product_id, CASE WHEN x.product_id IS NULL THEN 'missing' WHEN pending > 0 THEN 'conflict' WHEN ok THEN 'verified' ELSE 'unverified' END AS status FROM part LEFT JOIN x ON x.product_id = p_partkey")
def value_status(spark, sf_dir):
    part = b.table(spark, sf_dir, "part")
    values = spark.sql(_STATES.format("{t}"), t=part).where("product_id % 6 > 0")
    return m.value_status(values, part.select(F.col("p_partkey").alias("product_id")))



@query("SELECT l_partkey AS product_id, l_returnflag AS key, arg_max(l_linestatus || repeat('*', CAST(l_quantity AS INTEGER) % 5), (l_linenumber = 3, CAST(l_quantity AS INTEGER) % 5, -(l_orderkey * 10 + l_linenumber))) AS value FROM lineitem GROUP BY ALL")
def best_worded_values(spark, sf_dir):
    """Of several values of a key the manufacturer's (here: the third line's), else the longest, else the first."""
    rows = b.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_returnflag").alias("key"), F.when(F.col("l_linenumber") == 3, "manufacturer").otherwise("store").alias("source"), F.concat("l_linestatus", F.expr("repeat('*', cast(l_quantity as int) % 5)")).alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return m.best_worded(rows)


@query("SELECT page_id, url FROM pages WHERE NOT starts_with(url, 'http://th') AND NOT contains(url, '?page=') AND (contains(lower(url), '/en/') OR contains(lower(url), '/de/'))")
def wanted_urls(spark, sf_dir):
    return m.wanted_urls(b.table(spark, sf_dir, "pages").select("page_id", "url"), prefixes=("http://th",), parts=("?page=",), keywords=("/EN/", "/de/"))


@query(
    f"WITH c AS ({_CURRENT.format('supplier')}), b AS ({_BATCH.format('supplier')}), f AS (SELECT b.*, coalesce((SELECT min(offer_id) FROM c WHERE c.store_id = b.store_id AND c.external_id = b.external_id), (SELECT min(offer_id) FROM c WHERE c.store_id = b.store_id AND c.url = b.url)) AS hit FROM b), o AS (SELECT CASE WHEN hit IS NULL THEN 'created' WHEN c.price <> f.price THEN 'price_changed' ELSE 'unchanged' END AS outcome, f.store_id % 10 = 0 AS bad FROM f LEFT JOIN c ON c.offer_id = hit) "
    "SELECT count(*) AS processed, count(*) FILTER (WHERE NOT bad AND outcome = 'created') AS created, count(*) FILTER (WHERE NOT bad AND outcome = 'price_changed') AS price_changed, count(*) FILTER (WHERE NOT bad AND outcome = 'unchanged') AS unchanged, 0 AS rejected, count(*) FILTER (WHERE bad) AS failed, 0 AS other FROM o"
)
def run_counters(spark, sf_dir):
    """Counters of the merge above; every tenth store's rows fail."""
    rows = offer_merge(spark, sf_dir).where("outcome <> 'untouched'").withColumn("error", F.when(F.col("store_id") % 10 == 0, "timeout"))
    return m.run_report(rows)
