"""Queries of data quality, specifications, evidence and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import bindings as b
from lodestone.bindings import with_views
from lodestone.functions.urls import source_confidence, source_priority
from lodestone.operators import evidence as e
from lodestone.operators import quality as q
from lodestone.registry import query

_SCORES = with_views("products", "spec_values", "definitions") + ", per AS (SELECT product_id, count(DISTINCT s.key) AS present FROM spec_values s JOIN definitions d ON d.key = s.key WHERE value_number IS NOT NULL OR trim(value_text) <> '' GROUP BY 1), sc AS (SELECT id, name, coalesce(present, 0) AS present, least(100, CASE WHEN length(name) > 0 THEN 5 ELSE 0 END + CASE WHEN length(brand) > 0 THEN 4 ELSE 0 END + CASE WHEN id % 4 > 0 THEN 3 ELSE 0 END + CASE WHEN id % 3 = 0 OR id % 5 = 0 THEN 3 ELSE 0 END + round_even(coalesce(present, 0) / 3::DOUBLE * 85, 0))::INTEGER AS score FROM products LEFT JOIN per ON product_id = id)"


def _scores(spark, sf_dir):
    """Three of four products have a model, every third a GTIN and every fifth a part number."""
    key = F.col("id").cast("string")
    products = b.products(spark, sf_dir).withColumns({"model": F.when(F.col("id") % 4 > 0, key), "gtin": F.when(F.col("id") % 3 == 0, key), "mpn": F.when(F.col("id") % 5 == 0, key)})
    return q.completeness(products, b.spec_values(spark, sf_dir), b.definitions(spark))


@query(_SCORES + " SELECT * FROM sc")
def completeness_report(spark, sf_dir):
    return _scores(spark, sf_dir)


@query(_SCORES + " SELECT * FROM (SELECT *, 'incomplete' AS kind FROM sc ORDER BY score, present, name, id LIMIT 20) UNION ALL SELECT * FROM (SELECT *, 'complete' AS kind FROM sc ORDER BY score DESC, present DESC, name DESC, id DESC LIMIT 20)")
def completeness_extremes(spark, sf_dir):
    return q.extremes(_scores(spark, sf_dir))


@query(_SCORES + " SELECT count(*) AS products, round_even(avg(score), 0)::INTEGER AS average_score FROM sc")
def average_completeness(spark, sf_dir):
    return _scores(spark, sf_dir).agg(F.count(F.lit(1)).alias("products"), F.bround(F.avg("score")).cast("int").alias("average_score"))


@query(with_views("products", "spec_values", "definitions") + ", c AS (SELECT category, count(*) AS products FROM products GROUP BY 1), u AS (SELECT category, key, count(DISTINCT product_id) AS n FROM spec_values JOIN products ON id = product_id GROUP BY ALL) SELECT c.category, d.key, products, coalesce(n, 0) AS with_value, round(coalesce(n, 0) * 100.0::DOUBLE / products, 1) AS coverage_pct FROM c CROSS JOIN definitions d LEFT JOIN u ON u.category = c.category AND u.key = d.key")
def coverage_by_definition(spark, sf_dir):
    return q.coverage(b.products(spark, sf_dir), b.spec_values(spark, sf_dir), b.definitions(spark))


@query("SELECT count(*) AS documents, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS labelled, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic, count(DISTINCT source) AS sources, count(DISTINCT lang) AS languages FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def dashboard_counts(spark, sf_dir):
    docs, labels = b.table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), b.table(spark, sf_dir, "labels")
    met = docs.join(labels.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left")
    return met.agg(F.count(F.lit(1)).alias("documents"), F.count("_id").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("languages"))


@query("SELECT 'lang' AS name, coalesce(lang, 'none') AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', coalesce(source, 'none'), count(*) FROM documents GROUP BY ALL")
def frequency_tables(spark, sf_dir):
    return q.frequencies(b.table(spark, sf_dir, "documents").select("lang", "source"), "lang", "source")


@query("SELECT p_partkey AS id FROM part WHERE p_size > 45 AND p_type = 'PROMO'")
def products_without_specs(spark, sf_dir):
    """Products of which neither the size nor the type is stated."""
    specs = b.spec_values(spark, sf_dir).where("key <> 'brand'")
    return q.without_specs(b.products(spark, sf_dir), specs).select("id")


_STATES = "states AS (SELECT user_id AS product_id, event_id AS value_id, CASE event_type WHEN 'error' THEN 'review' WHEN 'signup' THEN 'auto' ELSE 'verified' END AS status, CASE WHEN event_type = 'error' AND value > 30 THEN 'pending' WHEN event_type = 'purchase' THEN 'resolved' ELSE 'none' END AS conflict, ts AS updated_at FROM events)"


def _states(spark, sf_dir):
    """Events as states of specification values."""
    kind = F.col("event_type")
    return b.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("product_id"), F.col("event_id").alias("value_id"), F.when(kind == "error", "review").when(kind == "signup", "auto").otherwise("verified").alias("status"),
        F.when((kind == "error") & (F.col("value") > 30), "pending").when(kind == "purchase", "resolved").otherwise("none").alias("conflict"), F.col("ts").alias("updated_at"),
    )


@query(f"WITH {_STATES} SELECT * FROM states WHERE status <> 'verified' OR conflict = 'pending' ORDER BY conflict DESC, updated_at DESC, value_id LIMIT 50")
def review_queue(spark, sf_dir):
    return q.review_queue(_states(spark, sf_dir), 50)


@query(f"WITH {_STATES} SELECT product_id, CASE WHEN count(*) FILTER (WHERE conflict = 'pending') > 0 THEN 'conflict' WHEN count(*) FILTER (WHERE status <> 'verified') = 0 THEN 'verified' ELSE 'unverified' END AS status FROM states GROUP BY 1")
def product_status(spark, sf_dir):
    return q.product_status(_states(spark, sf_dir))


@query(f"WITH {_STATES} SELECT value_id // 4 AS product_id FROM states GROUP BY 1 HAVING count(*) FILTER (WHERE status <> 'verified') = 0")
def verified_products(spark, sf_dir):
    """Four events in a row are a product's values."""
    return q.fully_verified(_states(spark, sf_dir).withColumn("product_id", F.floor(F.col("value_id") / 4)))


_RANK = "CASE WHEN {0}.status = 'verified' THEN 100 ELSE CASE {0}.source WHEN " + " WHEN ".join(f"'{name}' THEN {rank}" for name, rank in q.SOURCE_PRIORITY.items()) + " ELSE 10 END END"

_INCOMING = """
    SELECT user_id AS product_id, event_type AS definition_id, event_id AS seq,
        CASE WHEN event_id % 3 = 0 THEN '{"boolean":' || CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 THEN 'true' ELSE 'false' END || '}'
            ELSE '{"number":' || CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 || '.0,"unit":"GB"}' END AS value,
        (['scraper', 'store', 'manufacturer', 'admin', 'unheard of'])[1 + event_id % 5] AS source, CASE WHEN value < 50 THEN 'shop ' || event_id % 2 END AS source_name,
        CASE WHEN value > 60 THEN 'verified' WHEN value < 3 THEN 'review' ELSE 'auto' END AS status, event_id % 11 = 0 AS forced
    FROM events
"""


@query(
    f"""WITH RECURSIVE i AS (SELECT *, row_number() OVER (PARTITION BY product_id, definition_id ORDER BY seq) AS n FROM ({_INCOMING})),
    f AS (
        SELECT product_id, definition_id, n, seq, 'created' AS action, value, source, source_name, status, CASE WHEN status = 'verified' THEN 'resolved' ELSE 'none' END AS conflict FROM i WHERE n = 1
        UNION ALL
        SELECT product_id, definition_id, n, seq, CASE o WHEN 1 THEN 'source_updated' WHEN 2 THEN 'conflict_detected' WHEN 3 THEN 'value_changed' END,
            CASE WHEN o = 3 THEN value ELSE old_value END, CASE WHEN o IN (1, 3) THEN source ELSE old_source END, CASE WHEN o IN (1, 3) THEN source_name ELSE old_name END,
            CASE WHEN o IN (0, 2) THEN old_status WHEN o = 3 AND status <> 'verified' THEN 'review' ELSE status END,
            CASE WHEN o = 0 THEN old_conflict WHEN o = 1 THEN CASE WHEN status = 'verified' THEN 'resolved' WHEN old_conflict = 'pending' THEN 'pending' ELSE 'none' END ELSE 'pending' END
        FROM (
            SELECT i.*, f.value AS old_value, f.source AS old_source, f.source_name AS old_name, f.status AS old_status, f.conflict AS old_conflict,
                CASE WHEN i.value = f.value THEN CASE WHEN i.source = f.source AND i.source_name IS NOT DISTINCT FROM f.source_name AND i.status = f.status THEN 0
                        WHEN i.forced OR {_RANK.format("i")} >= {_RANK.format("f")} THEN 1 ELSE 0 END
                    WHEN (f.status = 'verified' AND i.source <> 'admin') OR {_RANK.format("i")} < {_RANK.format("f")} THEN 2 ELSE 3 END AS o
            FROM f JOIN i ON i.product_id = f.product_id AND i.definition_id = f.definition_id AND i.n = f.n + 1))
    SELECT product_id, definition_id, seq, action, value, source, source_name, status, conflict FROM f WHERE action IS NOT NULL"""
)
def spec_upsert_fold(spark, sf_dir):
    """Events as incoming values of (user, event type): numbers and booleans, from five sources, verified from 60 on."""
    k, n = F.get_json_object("props", "$.k").cast("int"), F.col("event_id")
    value = F.when(n % 3 == 0, q.snapshot(boolean=k % 2 == 0)).otherwise(q.snapshot(number=k % 5, unit=F.lit("GB")))
    source = F.element_at(F.array(*map(F.lit, ("scraper", "store", "manufacturer", "admin", "unheard of"))), (n % 5 + 1).cast("int"))
    incoming = b.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("product_id"), F.col("event_type").alias("definition_id"), n.alias("seq"), value.alias("_v"), source.alias("source"),
        F.when(F.col("value") < 50, F.concat(F.lit("shop "), (n % 2).cast("string"))).alias("source_name"),
        F.when(F.col("value") > 60, "verified").when(F.col("value") < 3, "review").otherwise("auto").alias("status"), (n % 11 == 0).alias("forced"),
    )
    found = q.upsert_fold(incoming.withColumnRenamed("_v", "value"))
    return found.select("product_id", "definition_id", "seq", "action", "value", "source", "source_name", "status", "conflict")


_EVIDENCE = "evidence AS (SELECT user_id || '/' || event_type AS claim, CASE WHEN value < 50 THEN CAST(CAST(floor(value / 25) AS BIGINT) AS VARCHAR) END AS value, (['manufacturer', 'benchmark', 'web'])[1 + event_id % 3] AS source, ts FROM events)"


def _evidence(spark, sf_dir):
    value = F.when(F.col("value") < 50, F.floor(F.col("value") / 25).cast("string"))
    source = F.element_at(F.array(*map(F.lit, ("manufacturer", "benchmark", "web"))), (F.col("event_id") % 3 + 1).cast("int"))
    return b.table(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", "event_type").alias("claim"), value.alias("value"), source.alias("source"), "ts")


@query(f"WITH {_EVIDENCE}, i AS (SELECT claim, value, row_number() OVER () AS n FROM evidence WHERE value IS NOT NULL), c AS (SELECT a.claim, count(*) AS k FROM i a JOIN i b ON a.claim = b.claim AND a.n < b.n AND a.value <> b.value GROUP BY 1), s AS (SELECT claim, sum(n)::BIGINT AS items, max(n) AS supporters, count(*) AS variants FROM (SELECT claim, value, count(*) AS n FROM i GROUP BY ALL) GROUP BY 1), a AS (SELECT DISTINCT claim FROM evidence) SELECT a.claim, coalesce(items, 0) AS items, coalesce(supporters, 0) AS supporters, coalesce(c.k, 0) AS conflicting_pairs, CASE WHEN items IS NULL THEN 'insufficient' WHEN variants = 1 THEN 'agreement' ELSE 'conflict' END AS verdict FROM a LEFT JOIN s ON s.claim = a.claim LEFT JOIN c ON c.claim = a.claim")
def claim_conflicts(spark, sf_dir):
    """A claim without two items has no conflicting pairs."""
    found = e.verdicts(_evidence(spark, sf_dir))
    return found.withColumn("conflicting_pairs", F.coalesce("conflicting_pairs", F.lit(0)))


@query(
    f"WITH {_EVIDENCE}, p AS (SELECT *, CASE source WHEN 'manufacturer' THEN 50 WHEN 'benchmark' THEN 40 ELSE 20 END AS priority, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 86400000000.0::DOUBLE AS days FROM evidence WHERE value IS NOT NULL), "
    "w AS (SELECT claim, value, max(0.5::DOUBLE * priority / 60.0::DOUBLE + 0.3::DOUBLE * CASE WHEN priority >= 50 THEN 0.9::DOUBLE WHEN priority >= 40 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END + 0.2::DOUBLE * greatest(0.0::DOUBLE, 1 - days / 90.0::DOUBLE)) AS weight FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY weight DESC, value) AS n, lead(weight) OVER (PARTITION BY claim ORDER BY weight DESC, value) AS nxt FROM w) "
    "SELECT claim, value, round(weight, 6) AS weight, nxt IS NULL OR weight - nxt >= 0.05::DOUBLE AS decided FROM r WHERE n = 1"
)
def claim_resolution(spark, sf_dir):
    items = _evidence(spark, sf_dir).where("value is not null")
    priority = source_priority(F.col("source"))
    days = (F.lit(1706745600000000) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(86400000000.0)
    return e.resolved(items.select("claim", "value", e.claim_weight(priority, source_confidence(priority), days).alias("weight")))


@query(
    "WITH s AS (SELECT p_type AS group_id, p_partkey AS product_id, 'size' AS criterion, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_type, p_partkey, 'value', 100000.0::DOUBLE / p_retailprice FROM part UNION ALL SELECT p_type, p_partkey, 'defects', -p_size::DOUBLE FROM part), b AS (SELECT group_id, criterion, max(value) AS best FROM s GROUP BY ALL HAVING max(value) > 0), "
    "t AS (SELECT s.group_id, s.product_id, round(sum(s.value / best * CASE s.criterion WHEN 'size' THEN 0.6::DOUBLE WHEN 'value' THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END), 6) AS score FROM s JOIN b ON b.group_id = s.group_id AND b.criterion = s.criterion GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, product_id) AS n FROM t) SELECT group_id, product_id, score FROM r WHERE n = 1"
)
def recommend_winner(spark, sf_dir):
    part = b.table(spark, sf_dir, "part")
    long = part.select(F.col("p_type").alias("group_id"), F.col("p_partkey").alias("product_id"), F.expr("stack(3, 'size', cast(p_size as double), 'value', 100000D / p_retailprice, 'defects', -cast(p_size as double)) as (criterion, value)"))
    return e.recommendation(long, {"size": 0.6, "value": 0.3, "defects": 0.1})
