"""Queries of specifications in words, research, memories and upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import bindings as b
from lodestone.bindings import with_views
from lodestone.functions.urls import meta_tags, platform
from lodestone.operators import admin, ingest, memory, research, sheets, specs
from lodestone.registry import query

_NAME = "p_name || ' ' || p_size || CASE p_size % 3 WHEN 0 THEN ' TB SSD' WHEN 1 THEN ' GB LPDDR5' ELSE ' GB disco duro' END || CASE p_size % 4 WHEN 0 THEN ' 1920x1080' WHEN 1 THEN ' QHD' ELSE '' END"


def _named(spark, sf_dir):
    size = F.col("p_size")
    tail = F.when(size % 3 == 0, " TB SSD").when(size % 3 == 1, " GB LPDDR5").otherwise(" GB disco duro")
    screen = F.when(size % 4 == 0, " 1920x1080").when(size % 4 == 1, " QHD").otherwise("")
    return b.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.concat("p_name", F.lit(" "), size.cast("string"), tail, screen).alias("name"))


@query(f"WITH n AS (SELECT p_partkey, p_size, {_NAME} AS name FROM part) SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size * 1024.0::DOUBLE ELSE p_size::DOUBLE END AS gigabytes, CASE p_size % 3 WHEN 0 THEN 'SSD' WHEN 2 THEN 'HDD' END AS storage, CASE WHEN p_size % 3 = 1 THEN 'LPDDR5' END AS memory, CASE p_size % 4 WHEN 0 THEN '1920 × 1080' WHEN 1 THEN '1366 × 768' END AS resolution FROM n")
def spec_words(spark, sf_dir):
    name = F.col("name")
    return _named(spark, sf_dir).select("p_partkey", specs.number_in(name, "GB").alias("gigabytes"), specs.storage_type(name).alias("storage"), specs.memory_type(name).alias("memory"), specs.resolution(name).alias("resolution"))


@query("WITH v AS (SELECT l_partkey AS product_id, l_returnflag AS key, CAST(CAST(l_quantity AS BIGINT) % 3 AS VARCHAR) AS value, min(l_orderkey) AS place, max(l_returnflag = 'N') AS multi, max(CAST(l_quantity AS BIGINT) % 3 = l_partkey % 3) AS hinted FROM lineitem GROUP BY ALL), a AS (SELECT product_id, key, count(*) AS n, max(multi) AS multi, count(*) FILTER (WHERE hinted) AS h, arg_min(value, (place, value)) AS first, min(value) FILTER (WHERE hinted) AS hint FROM v GROUP BY ALL) SELECT product_id, key, CASE WHEN n = 1 OR multi THEN first WHEN h = 1 THEN hint END AS value, n AS candidates, CASE WHEN n = 1 OR multi THEN first WHEN h = 1 THEN hint END IS NULL AS ambiguous FROM a")
def variant_resolution(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem")
    three = F.col("l_quantity").cast("bigint") % 3
    rows = lines.select(F.col("l_partkey").alias("product_id"), F.col("l_returnflag").alias("key"), three.cast("string").alias("value"), F.col("l_orderkey").alias("place"), (F.col("l_returnflag") == "N").alias("multi"), (three == F.col("l_partkey") % 3).alias("hinted"))
    return specs.resolved(rows)


@query("WITH v AS (SELECT l_partkey AS product_id, l_returnflag AS key, l_suppkey AS source, l_suppkey % 7 AS priority, CAST(l_quantity AS BIGINT) % 2 AS value FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY product_id, key ORDER BY priority, source, value) AS n, dense_rank() OVER (PARTITION BY product_id, key ORDER BY source) AS s, dense_rank() OVER (PARTITION BY product_id, key ORDER BY value) AS d FROM v) SELECT product_id, key, max(value) FILTER (WHERE n = 1) AS value, max(source) FILTER (WHERE n = 1) AS source, max(s) AS sources, key IN ('A', 'R') AND max(s) > 1 AND max(d) > 1 AS conflict FROM r GROUP BY product_id, key")
def spec_cross_validation(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_returnflag").alias("key"), F.col("l_suppkey").alias("source"), (F.col("l_suppkey") % 7).alias("priority"), (F.col("l_quantity").cast("bigint") % 2).alias("value"))
    return specs.cross_validated(lines, ["A", "R"])


_ALIASES = (("Red  Widget", 1), ("bolt", 2), ("BL", 3), ("ing", 4))


@query("WITH a AS (SELECT * FROM (VALUES ('red widget', 1), ('bolt', 2), ('bl', 3), ('ing', 4)) t(alias, source)) SELECT DISTINCT p_partkey AS id, source FROM part JOIN a ON contains(lower(p_name), alias)")
def alias_join(spark, sf_dir):
    """Aliases inside words count, too."""
    return specs.by_alias(b.products(spark, sf_dir), spark.createDataFrame(_ALIASES, "alias string, source int"))


_COMPONENTS = "SELECT lower(n_name) AS alias, 'origin' AS section, 'region ' || n_regionkey % 2 AS label, n_name || ' ' || n_regionkey AS value FROM nation UNION ALL SELECT lower(r_name), 'origin', 'continent', r_name FROM region UNION ALL SELECT substr(lower(n_name), 1, 2), 'hint', 'start', n_name FROM nation"


@query(
    f"""WITH c AS ({_COMPONENTS}), t AS (SELECT doc_id AS product_id, lower(strip_accents(regexp_replace(coalesce(text, ''), '[^A-Za-zÀ-ÿ0-9]+', ' ', 'g'))) AS said, lang FROM documents),
    found AS (SELECT DISTINCT product_id, section, label, alias, value FROM t JOIN c ON contains(said, alias)),
    first AS (SELECT product_id, section, label, arg_min(value, (alias, value)) AS value FROM found GROUP BY ALL)
    SELECT first.* FROM first JOIN documents d ON d.doc_id = product_id WHERE NOT (section = 'hint' AND d.lang = 'de')"""
)
def component_enrichment(spark, sf_dir):
    """Names of nations and regions, and their first two letters, as components that a document's text may name; German documents have the hint already."""
    nation, region = b.table(spark, sf_dir, "nation"), b.table(spark, sf_dir, "region")
    parts = nation.select(F.lower("n_name").alias("alias"), F.lit("origin").alias("section"), F.concat(F.lit("region "), F.col("n_regionkey") % 2).alias("label"), F.concat_ws(" ", "n_name", "n_regionkey").alias("value"))
    parts = parts.unionByName(region.select(F.lower("r_name").alias("alias"), F.lit("origin").alias("section"), F.lit("continent").alias("label"), F.col("r_name").alias("value")))
    parts = parts.unionByName(nation.select(F.substring(F.lower("n_name"), 1, 2).alias("alias"), F.lit("hint").alias("section"), F.lit("start").alias("label"), F.col("n_name").alias("value")))
    docs = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    known = docs.where("lang = 'de'").select(F.col("id").alias("product_id"), F.lit("Hint").alias("section"), F.lit("START").alias("label"))
    return specs.enriched(docs, parts, known, "text")


_TOPIC = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(coalesce(text, '')), '{m}')" for m in marks) + f" THEN '{name}' END" for name, marks, _, _ in research.TOPICS) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT conv_id, turn, {_TOPIC} AS topics FROM conversations")
def message_topics(spark, sf_dir):
    return b.table(spark, sf_dir, "conversations").select("conv_id", "turn", research.topics(F.col("text")).alias("topics"))


_PLANS = ", ".join(f"({i + 1}, '{name}', '{suffix}', '{kind}', [" + ", ".join(f"'{w}'" for w in marks) + "])" for i, (name, marks, suffix, kind) in enumerate(research.TOPICS))


@query(
    f"WITH t(priority, topic, suffix, kind, marks) AS (VALUES {_PLANS}), m AS (SELECT p_partkey AS target_id, p_brand || ' ' || p_name AS label, 'rendimiento y precio ' || CASE WHEN p_type = 'PROMO' THEN 'gaming' ELSE 'consumo' END AS message FROM part), "
    "h AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY priority) AS n FROM m JOIN t ON len(list_filter(marks, lambda x: contains(message, x))) > 0) SELECT target_id, topic, label || ' ' || suffix AS query, kind AS expected, priority FROM h WHERE n <= 3"
)
def planned_queries(spark, sf_dir):
    """A query for each part and topic of a message made from its type; the tests hold scores and plans against cases."""
    message = F.concat(F.lit("rendimiento y precio "), F.when(F.col("p_type") == "PROMO", "gaming").otherwise("consumo"))
    targets = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target_id"), F.concat_ws(" ", "p_brand", "p_name").alias("label"), message.alias("message"))
    return research.planned(targets, "message", 3)


@query("WITH s AS (SELECT source AS doc, doc_id AS place, coalesce(text, '') AS content FROM documents), w AS (SELECT *, coalesce(sum(length(content)) OVER (PARTITION BY doc ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM s) SELECT doc, place, substr(content, 1, 14000 - b) AS content FROM w WHERE b < 14000")
def context_budget(spark, sf_dir):
    """The documents of each source in order, as far as 4000 tokens reach."""
    sections = b.table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("place"), F.coalesce("text", F.lit("")).alias("content"))
    return research.budgeted(sections, 4000)


@query("SELECT user_id, event_type AS goal, max(event_id) AS seq, arg_max(props, event_id) AS content, count(*) AS times FROM events GROUP BY user_id, event_type")
def episode_upsert(spark, sf_dir):
    return memory.episodes(b.table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("goal"), F.col("event_id").alias("seq"), F.col("props").alias("content")))


@query("WITH m AS (SELECT user_id, event_id AS memory_id, 1 + event_id % 5 AS importance FROM events WHERE event_type = 'view'), c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, memory_id DESC) AS rank FROM m WHERE importance >= 4), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY memory_id) AS rank FROM m), u AS (SELECT user_id, memory_id, rank AS place FROM c WHERE rank <= 3 UNION ALL SELECT user_id, memory_id, rank + 1000 FROM f WHERE rank <= 4), d AS (SELECT user_id, memory_id, min(place) AS place FROM u GROUP BY ALL) SELECT user_id, memory_id, row_number() OVER (PARTITION BY user_id ORDER BY place)::INTEGER AS place FROM d")
def memory_recall(spark, sf_dir):
    """Core memories and, as a stand-in for a search, each user's first four."""
    memories = b.table(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", F.col("event_id").alias("memory_id"), (1 + F.col("event_id") % 5).alias("importance"), F.lit("preference").alias("kind"))
    found = specs.ranked_within(memories.withColumn("score", F.lit(0)), ["user_id"], "score", "memory_id", 4)
    return memory.recalled(memory.core(memories), found)


@query()
def memory_near_duplicates(spark, sf_dir):
    """Vectors as memories of their label; an ordered fold beyond SQL, held against a brute-force one in the tests."""
    rows = b.table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("user_id"), (F.col("vec_id") % 2).cast("string").alias("kind"), F.col("vec_id").alias("seq"), F.concat(F.lit("Memory "), "vec_id").alias("content"), F.col("embedding").alias("vector"), (1 + F.col("vec_id") % 5).cast("int").alias("importance"))
    return memory.added(rows)


@query("SELECT page_id, CASE WHEN contains(lower(html), 'shopify') THEN 'Shopify' WHEN contains(lower(html), 'vtex') THEN 'VTEX' WHEN contains(lower(html), 'nextjs') OR contains(html, '_next/static') THEN 'Next.js' WHEN contains(lower(html), 'woocommerce') OR contains(html, 'wp-content') THEN 'WooCommerce' END AS platform FROM pages")
def page_platform(spark, sf_dir):
    html = F.col("html")
    return b.table(spark, sf_dir, "pages").select("page_id", platform(html, meta_tags(html))["name"].alias("platform"))


@query("WITH moves AS (SELECT p_partkey AS old_id, p_partkey - 1 AS new_id FROM part WHERE p_partkey % 10 = 1), o AS (SELECT DISTINCT l_partkey AS product_id, l_suppkey AS store_id FROM lineitem), r AS (SELECT coalesce(new_id, product_id) AS product_id, store_id FROM o LEFT JOIN moves ON old_id = product_id) SELECT p_partkey AS id, (SELECT count(*) FROM r WHERE r.product_id = p_partkey) AS offers FROM part WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.product_id = p_partkey)")
def entity_merge(spark, sf_dir):
    """Every product that ends in 1 is merged into its predecessor; the products left without offers."""
    moves = b.table(spark, sf_dir, "part").where("p_partkey % 10 = 1").select(F.col("p_partkey").alias("old_id"), (F.col("p_partkey") - 1).alias("new_id"))
    offers = b.offers(spark, sf_dir).select("product_id", "store_id")
    return admin.orphans(b.products(spark, sf_dir), admin.relinked(offers, moves)).select("id", F.lit(0).cast("bigint").alias("offers"))


@query(with_views("products", "offers") + ", l AS (SELECT product_id, min(price) AS old_min FROM offers JOIN products ON id = product_id AND name ILIKE '%bolt%' GROUP BY 1) SELECT o.product_id, o.store_id, CASE WHEN l.old_min IS NOT NULL THEN 100 ELSE o.price END::BIGINT AS price, l.old_min FROM offers o LEFT JOIN l ON l.product_id = o.product_id")
def demo_price_drop(spark, sf_dir):
    return admin.dropped_price(b.products(spark, sf_dir), b.offers(spark, sf_dir), "%bolt%", 100)


@query("SELECT user_id, event_id FROM events e WHERE value > 99 OR NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.value > 99)")
def filter_with_fallback(spark, sf_dir):
    events = b.table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return admin.filter_or_all(events, F.col("value") > 99, "user_id").select("user_id", "event_id")


_RANKED = "SELECT product_id, store_id, price, row_number() OVER (PARTITION BY product_id ORDER BY price, store_id) AS n FROM offers"


@query(with_views("products", "offers") + f", r AS ({_RANKED}), t AS (SELECT product_id, string_agg(store_id || '=' || price, ', ' ORDER BY n) AS offers FROM r WHERE n <= 3 GROUP BY 1) SELECT p.id, concat_ws('; ', p.name, p.brand, t.offers) AS sheet FROM products p LEFT JOIN t ON t.product_id = p.id")
def fact_sheets(spark, sf_dir):
    return admin.facts(b.products(spark, sf_dir), b.offers(spark, sf_dir))


@query("SELECT source AS name, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY source")
def labelled_sources(spark, sf_dir):
    labels = b.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "_id")
    met = b.table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, F.col("doc_id") == F.col("_id"))
    return met.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good"))



@query(with_views("products", "spec_values") + ", v AS (SELECT product_id, key, coalesce(CASE WHEN value_number IS NOT NULL THEN CAST(value_number AS BIGINT)::VARCHAR || ' cm' END, value_text, '') AS value FROM spec_values) SELECT p.id, p.brand || '|' || p.category AS general, coalesce(string_agg(v.key || '=' || v.value, ';' ORDER BY v.key), '') AS groups FROM products p LEFT JOIN v ON v.product_id = p.id AND v.value <> '' GROUP BY p.id, p.brand, p.category")
def spec_sheets(spark, sf_dir):
    """One group a key, written out for the comparison."""
    none = F.lit(None)
    value = sheets.shown(none.cast("boolean"), F.col("value_number"), F.col("value_text"), none.cast("array<string>"), F.when(F.col("key") == "size", "cm"), none.cast("string"))
    values = b.spec_values(spark, sf_dir).select("product_id", F.col("key").alias("group"), F.lit(0).alias("sort_order"), F.col("key").alias("label"), value.alias("value"))
    made = sheets.sheets(b.products(spark, sf_dir), values)
    groups = F.transform("groups", lambda g: F.concat_ws("=", g["group"], F.array_join(F.transform(g["items"], lambda i: i["value"]), ",")))
    return made.select("id", F.array_join(F.transform("general", lambda g: g["value"]), "|").alias("general"), F.array_join(groups, ";").alias("groups"))


@query("WITH p AS (SELECT p_type || '/' || p_brand AS key, p_partkey, p_size FROM part), a AS (SELECT key, max(p_size) AS top, count(*) AS n FROM p GROUP BY 1), t AS (SELECT p.key, count(*) AS ties, max(p_partkey) AS product_id FROM p JOIN a ON a.key = p.key AND top = p_size GROUP BY 1) SELECT a.key, t.product_id, a.top::DOUBLE AS number FROM a JOIN t ON t.key = a.key WHERE ties = 1 AND n > 1")
def sole_advantages(spark, sf_dir):
    """The one largest part of each type and brand."""
    rows = b.table(spark, sf_dir, "part").select(F.concat_ws("/", "p_type", "p_brand").alias("key"), F.col("p_partkey").alias("product_id"), F.col("p_size").cast("double").alias("number"))
    return sheets.advantages(rows)


@query("SELECT page_id, CASE WHEN regexp_matches(p, 'bundle|bulto|pack|combo|kit|set|lote|regalo|obsequio|gift') THEN 'is_bundle' WHEN regexp_matches(p, 'servicio|service|suscripcion|subscription|garantia|warranty|seguro|plan|mantencion|soporte|instalacion|configuracion|gift-card|tarjeta-de-regalo|vale|voucher|credito|saldo') THEN 'is_service' END AS reason FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) AS p FROM pages)")
def url_eligibility(spark, sf_dir):
    return b.table(spark, sf_dir, "pages").select("page_id", ingest.url_eligibility(F.col("url")).alias("reason"))
