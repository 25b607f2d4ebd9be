"""Queries of offers, price histories, trends, alerts and ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import bindings as b
from lodestone.bindings import with_views
from lodestone.functions.text import condition, stock
from lodestone.operators import ingest
from lodestone.operators import prices as p
from lodestone.registry import query

_BEST = "best AS (SELECT product_id, price, store_id FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, store_id) AS n FROM offers WHERE available AND currency = 'CLP') WHERE n = 1)"
_ORDER = "PARTITION BY product_id, store_id ORDER BY observed_at, order_id, line_no"


@query(with_views("offers") + ", " + _BEST + " SELECT * FROM best")
def best_offer(spark, sf_dir):
    return p.best_offers(b.offers(spark, sf_dir))


@query(with_views("offers") + " SELECT product_id, store_id, price, n::INTEGER AS rank, total FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, store_id) AS n, count(*) OVER (PARTITION BY product_id) AS total FROM offers) WHERE n <= 3")
def offers_ranked(spark, sf_dir):
    return p.ranked_offers(b.offers(spark, sf_dir), 3)


@query(with_views("products", "offers") + ", " + _BEST + ", n AS (SELECT product_id, count(*) AS n FROM offers GROUP BY 1) SELECT p.id, coalesce(p.category, 'Sin categoría') AS category, coalesce(best.price, 0) AS price_clp, coalesce(n.n, 0) AS offer_count FROM products p LEFT JOIN n ON n.product_id = p.id LEFT JOIN best ON best.product_id = p.id")
def price_cards(spark, sf_dir):
    return p.price_cards(b.products(spark, sf_dir), b.offers(spark, sf_dir))


@query(with_views("observations") + ", r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY observed_at DESC, order_id DESC, line_no DESC) AS back FROM observations), t AS (SELECT * FROM r WHERE back <= 5) SELECT product_id, store_id, price, observed_at, order_id, line_no, available, (count(*) OVER (PARTITION BY product_id) - back + 1)::INTEGER AS position FROM t")
def price_history_tail(spark, sf_dir):
    return p.history_tail(b.observations(spark, sf_dir), 5)


@query(with_views("observations") + f", s AS (SELECT *, lag(price) OVER ({_ORDER}) AS previous FROM observations) SELECT * FROM s WHERE previous IS NULL OR previous <> price")
def price_changes(spark, sf_dir):
    return p.changes(b.observations(spark, sf_dir))


@query(with_views("observations") + ", a AS (SELECT product_id, min(price) AS low, max(price) AS high, arg_min(price, (observed_at, order_id, line_no)) AS first_price, arg_max(price, (observed_at, order_id, line_no)) AS last_price FROM observations GROUP BY 1) SELECT *, CASE WHEN first_price = 0 THEN 0.0::DOUBLE ELSE (last_price - first_price)::DOUBLE / first_price * 100 END AS change_pct FROM a")
def price_change_pct(spark, sf_dir):
    return p.change_pct(b.observations(spark, sf_dir))


@query(
    with_views("offers") + ", " + _BEST + ", s AS (SELECT product_id, count(*) FILTER (WHERE price <> 0) AS points, min(price) FILTER (WHERE price <> 0) AS low, max(price) FILTER (WHERE price <> 0) AS high, round_even(sum(price)::DOUBLE / count(*) FILTER (WHERE price <> 0), 0)::BIGINT AS mean FROM observations GROUP BY 1) SELECT s.product_id, points, low, high, mean, best.price AS current, "
    "CASE WHEN best.price IS NULL THEN 'sin_precio_actual' WHEN points < 3 THEN 'sin_historial_suficiente' WHEN best.price <= low * 1.03::DOUBLE THEN 'buen_momento' WHEN best.price >= mean * 1.05::DOUBLE THEN 'esperar' ELSE 'precio_normal' END AS verdict FROM s LEFT JOIN best ON best.product_id = s.product_id"
)
def trend_verdict(spark, sf_dir):
    return p.trends(b.observations(spark, sf_dir), p.best_offers(b.offers(spark, sf_dir)))


@query(with_views("products", "observations") + ", t AS (SELECT id * 10 + 1 AS alert_id, id AS product_id, list_price * 2 AS target FROM products), f AS (SELECT alert_id, min(observed_at) AS fired_at FROM t JOIN observations o ON o.product_id = t.product_id AND o.available AND o.price <= t.target GROUP BY 1) SELECT t.product_id, t.target, t.alert_id, f.fired_at FROM t LEFT JOIN f ON f.alert_id = t.alert_id")
def alert_trigger(spark, sf_dir):
    targets = b.products(spark, sf_dir).select((F.col("id") * 10 + 1).alias("alert_id"), F.col("id").alias("product_id"), (F.col("list_price") * 2).alias("target"))
    return p.alerts(targets, b.observations(spark, sf_dir))


@query(with_views("offers") + ", " + _BEST + ", items AS (SELECT DISTINCT o_custkey AS list_id, l_partkey AS product_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey) SELECT list_id, count(best.price) AS available, count(*) AS wanted, coalesce(sum(best.price), 0)::BIGINT AS total, coalesce(sum(best.price), 0) <= 100000 AS within_budget FROM items i LEFT JOIN best ON best.product_id = i.product_id GROUP BY list_id")
def basket_total(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("product_id"))
    items = b.table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("o")).select(F.col("o_custkey").alias("list_id"), "product_id")
    return p.basket(items, b.offers(spark, sf_dir), 100_000)


@query(with_views("products", "offers") + ", " + _BEST + ", d AS (SELECT p.id, CAST(floor((p.list_price * 3 - best.price)::DOUBLE / (p.list_price * 3) * 100 + 0.5::DOUBLE) AS BIGINT) AS pct FROM products p JOIN best ON best.product_id = p.id) SELECT id, CASE WHEN pct > 0 THEN pct END AS discount FROM d")
def discount_pct(spark, sf_dir):
    best = p.best_offers(b.offers(spark, sf_dir))
    met = b.products(spark, sf_dir).join(best, F.col("id") == F.col("product_id"))
    return met.select("id", p.discount_pct(F.col("list_price") * 3, F.col("price")).alias("discount"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 12")
def latest_activity(spark, sf_dir):
    return b.table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(12).select("o_orderkey", "o_orderdate")


@query(with_views("products", "offers") + " SELECT * FROM products p WHERE NOT EXISTS (SELECT 1 FROM offers o WHERE o.product_id = p.id AND o.available AND o.price < 2500)")
def products_without_offers(spark, sf_dir):
    """Products without an available offer under 2500."""
    cheap = b.offers(spark, sf_dir).where("available and price < 2500").select(F.col("product_id").alias("id"))
    return b.products(spark, sf_dir).join(cheap, "id", "left_anti")


@query(with_views("observations") + f", s AS (SELECT price, lag(price) OVER ({_ORDER}) AS previous FROM observations) SELECT count(*) AS processed, count(*) FILTER (WHERE previous IS NULL) AS created, count(*) FILTER (WHERE previous <> price) AS price_changes, count(*) FILTER (WHERE previous = price) AS unchanged FROM s")
def ingestion_report(spark, sf_dir):
    return ingest.report(b.observations(spark, sf_dir))


_SPLIT = "TIMESTAMP '2000-01-01'"
_LAST = "SELECT product_id, store_id, price, available, observed_at FROM (SELECT *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY observed_at DESC, order_id DESC, line_no DESC, price DESC, available DESC) AS n FROM observations WHERE observed_at {} " + _SPLIT + ") WHERE n = 1"


@query(with_views("observations") + f", a AS ({_LAST.format('<')}), b AS ({_LAST.format('>=')}) SELECT coalesce(a.product_id, b.product_id) AS product_id, coalesce(a.store_id, b.store_id) AS store_id, coalesce(b.price, a.price) AS price, coalesce(b.available, a.available) AS available, coalesce(b.observed_at, a.observed_at) AS observed_at, CASE WHEN b.price IS NULL THEN 'kept' WHEN a.price IS NULL THEN 'created' WHEN a.price <> b.price THEN 'price_changed' ELSE 'updated' END AS change FROM a FULL JOIN b ON a.product_id = b.product_id AND a.store_id = b.store_id")
def offer_upsert(spark, sf_dir):
    """The offers known before the year 2000, and a batch of all later observations merged into them."""
    seen = b.observations(spark, sf_dir)
    old = seen.where(F.col("observed_at") < F.expr("timestamp_ntz'2000-01-01'"))
    last = F.max(F.struct("observed_at", "order_id", "line_no", "price", "available")).alias("last")
    current = old.groupBy("product_id", "store_id").agg(last).select("product_id", "store_id", "last.price", "last.available", "last.observed_at")
    return ingest.merge_offers(current, seen.where(F.col("observed_at") >= F.expr("timestamp_ntz'2000-01-01'")))


_CASES = "CASE WHEN l_linenumber = 1 THEN '' ELSE 'store' END AS source, CASE WHEN l_linenumber = 2 THEN 'ftp://x' ELSE 'https://shop.example/' || l_partkey END AS product_url, CASE WHEN l_linenumber = 3 THEN 'PESO' ELSE 'CLP' END AS currency, CASE WHEN l_returnflag = 'A' THEN 'broken' ELSE 'new' END AS condition"


@query(f"WITH o AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / l_quantity) AS BIGINT) - 1500 AS price, {_CASES} FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN source = '' THEN 'source_or_name_missing' WHEN NOT regexp_matches(product_url, '^https?:') THEN 'url_not_http' WHEN price <= 0 THEN 'price_not_positive' WHEN length(currency) <> 3 THEN 'currency_not_iso' WHEN condition = 'broken' THEN 'condition_unknown' END AS reject_reason FROM o")
def offer_validation(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem")
    cases = lines.select(
        "l_orderkey", "l_linenumber", (F.floor(F.col("l_extendedprice") / F.col("l_quantity")) - 1500).alias("price"), F.lit("x").alias("name"),
        F.when(F.col("l_linenumber") == 1, "").otherwise("store").alias("source"),
        F.when(F.col("l_linenumber") == 2, "ftp://x").otherwise(F.concat(F.lit("https://shop.example/"), "l_partkey")).alias("product_url"),
        F.when(F.col("l_linenumber") == 3, "PESO").otherwise("CLP").alias("currency"), F.when(F.col("l_returnflag") == "A", "broken").otherwise("new").alias("condition"),
    )
    return cases.select("l_orderkey", "l_linenumber", ingest.reject_reason().alias("reject_reason"))


_NAMES = "p_name || CASE p_size % 6 WHEN 0 THEN ' headset' WHEN 1 THEN ' plan' WHEN 2 THEN ' voucher' ELSE '' END"
_LIKE = lambda words: " OR ".join(f"contains(name, '{w}')" for w in words)


@query(f"WITH o AS (SELECT p_partkey, lower({_NAMES}) AS name, p_type FROM part) SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'missing_category' WHEN {_LIKE(ingest.BUNDLES)} THEN 'is_bundle' WHEN {_LIKE(ingest.SERVICES)} THEN 'is_service' WHEN {_LIKE(ingest.GIFT_CARDS)} THEN 'is_service' END AS reason FROM o")
def eligibility_reasons(spark, sf_dir):
    part = b.table(spark, sf_dir, "part")
    kind = F.col("p_size") % 6
    name = F.concat("p_name", F.when(kind == 0, " headset").when(kind == 1, " plan").when(kind == 2, " voucher").otherwise(""))
    category = F.when(F.col("p_type") != "PROMO", F.col("p_type"))
    return part.select("p_partkey", ingest.eligibility(name, F.concat(F.lit("https://shop.example/"), "p_partkey"), F.col("p_retailprice"), category, F.col("p_partkey").cast("string")).alias("reason"))


_SAYINGS = ("NewCondition", "Open-Box", "reacondicionado", "semi nuevo", "usado", "https://schema.org/UsedCondition", "sellado")
_SAY = "(['" + "', '".join(_SAYINGS) + "'])[1 + l_linenumber % 7]"


@query(f"SELECT said, condition, count(*) AS n FROM (SELECT {_SAY} AS said, CASE WHEN contains(t, 'open box') OR contains(t, 'openbox') THEN 'open_box' WHEN contains(t, 'refurb') OR contains(t, 'reacond') THEN 'refurbished' WHEN contains(t, 'semi') AND contains(t, 'nuevo') THEN 'semi_new' WHEN contains(t, 'used') OR contains(t, 'usado') THEN 'used' WHEN contains(t, 'new') OR contains(t, 'nuevo') THEN 'new' ELSE 'unknown' END AS condition FROM (SELECT l_linenumber, regexp_replace(lower({_SAY}), '[_-]', ' ', 'g') AS t FROM lineitem)) GROUP BY ALL")
def condition_map(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, _SAYINGS)), (1 + F.col("l_linenumber") % 7).cast("int"))
    return b.table(spark, sf_dir, "lineitem").select(said.alias("said")).groupBy("said").agg(F.count(F.lit(1)).alias("n")).select("said", condition(F.col("said")).alias("condition"), "n")


_STOCKS = ("https://schema.org/InStock", "OutOfStock", "unavailable", "Available", "Agotado", "preorder")
_STK = "(['" + "', '".join(_STOCKS) + "'])[1 + l_linenumber % 6]"


@query(f"SELECT said, CASE WHEN regexp_matches(t, 'outofstock|soldout|unavailable|discontinued|agotado') THEN 'out_of_stock' WHEN regexp_matches(t, 'instock|available|disponible|limited') THEN 'in_stock' ELSE 'unknown' END AS stock, n FROM (SELECT {_STK} AS said, regexp_replace(lower({_STK}), '[^a-z]', '', 'g') AS t, count(*) AS n FROM lineitem GROUP BY ALL)")
def stock_map(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, _STOCKS)), (1 + F.col("l_linenumber") % 6).cast("int"))
    return b.table(spark, sf_dir, "lineitem").select(said.alias("said")).groupBy("said").agg(F.count(F.lit(1)).alias("n")).select("said", stock(F.col("said")).alias("stock"), "n")
