"""Queries of identity resolution. Products are parts; an offer is a part as another store would write it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import bindings as b
from lodestone.functions import text as t
from lodestone.operators import identity as i
from lodestone.registry import query

_CODE = "CAST(10000000 + p_partkey AS VARCHAR)"


def _products(spark, sf_dir):
    """gtin: eight digits; mpn: MP-<id / 2>, so that two products of a pair may share it; sku: letters and digits for even sizes, digits for odd ones."""
    return b.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.when(F.col("p_partkey") % 3 == 0, (F.lit(10_000_000) + F.col("p_partkey")).cast("string")).alias("gtin"), F.col("p_brand").alias("brand"),
        F.concat(F.lit("MP-"), F.floor(F.col("p_partkey") / 2).cast("string"), F.lit("/X")).alias("mpn"), F.concat(F.col("p_name"), F.lit(" "), F.col("p_size").cast("string")).alias("model"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("sku"), "p_partkey")).otherwise(F.col("p_partkey").cast("string")).alias("sku"), F.lit(False).alias("sku_is_identity"), F.col("p_name").alias("name"),
    )


_P = f"p AS (SELECT p_partkey AS product_id, CASE WHEN p_partkey % 3 = 0 THEN {_CODE} END AS gtin, p_brand AS brand, 'MP-' || CAST(floor(p_partkey / 2) AS BIGINT) || '/X' AS mpn, p_name || ' ' || p_size AS model, CASE WHEN p_size % 2 = 0 THEN 'sku' || p_partkey ELSE p_partkey::VARCHAR END AS sku, p_name AS name FROM part)"


def _offers(spark, sf_dir):
    """The same keys in another spelling, for the product itself or, for the GTIN of every 30th, its third next neighbour."""
    p = _products(spark, sf_dir)
    other = F.col("product_id") % 30 == 0
    return p.select(
        F.col("product_id").alias("offer_id"), F.when(F.col("gtin").isNotNull(), F.concat(F.lit(" "), (F.lit(10_000_000) + F.col("product_id") + F.when(other, 3).otherwise(0)).cast("string"))).alias("gtin"),
        F.upper("brand").alias("brand"), F.regexp_replace(F.lower("mpn"), "[-/]", " ").alias("mpn"), F.upper("model").alias("model"), F.concat(F.lit(" "), F.upper("sku")).alias("sku"),
        F.lit(False).alias("sku_is_identity"), F.concat(F.lit("the "), "name").alias("name"),
    )


_O = f"o AS (SELECT product_id AS offer_id, CASE WHEN gtin IS NOT NULL THEN CAST(10000000 + product_id + CASE WHEN product_id % 30 = 0 THEN 3 ELSE 0 END AS VARCHAR) END AS gtin, lower(brand) AS brand, lower(model) AS model, upper(sku) AS sku, upper(mpn) AS mpn, name FROM p)"


@query(f"WITH {_P} SELECT product_id, gtin, lower(brand) AS brand, upper(mpn) AS mpn, lower(model) AS model, upper(sku) AS sku, [upper(mpn), regexp_replace(upper(mpn), '[-/]', '', 'g'), regexp_replace(upper(mpn), '[-/]', ' ', 'g')] AS forms, trim(regexp_replace(lower(model), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM p")
def identity_normalize(spark, sf_dir):
    p = _products(spark, sf_dir)
    return p.select("product_id", t.gtin(F.col("gtin")).alias("gtin"), t.brand_key(F.col("brand")).alias("brand"), t.mpn_key(F.col("mpn")).alias("mpn"), t.model_key(F.col("model")).alias("model"), t.sku_key(F.col("sku")).alias("sku"), t.mpn_forms(F.col("mpn")).alias("forms"), t.slug(F.col("model")).alias("slug"))


_PAIRS = "SELECT DISTINCT o.offer_id, p.product_id FROM o JOIN p ON o.mpn = upper(p.mpn) AND o.brand = lower(p.brand)"


@query(f"WITH {_P}, {_O} {_PAIRS}")
def mpn_variant_join(spark, sf_dir):
    return i.mpn_pairs(_offers(spark, sf_dir), _products(spark, sf_dir))


_RUNGS = (
    "r AS (SELECT o.offer_id, p.product_id, 0 AS rung FROM o JOIN p ON o.gtin = p.gtin UNION ALL "
    f"SELECT *, 1 FROM ({_PAIRS}) UNION ALL "
    "SELECT o.offer_id, p.product_id, 2 FROM o JOIN p ON o.sku = upper(p.sku) AND o.brand = lower(p.brand) WHERE NOT regexp_matches(o.sku, '^[0-9]+$') UNION ALL "
    "SELECT o.offer_id, p.product_id, 3 FROM o JOIN p ON o.model = lower(p.model) AND o.brand = lower(p.brand))"
)


@query(
    f"WITH {_P}, {_O}, {_RUNGS}, n AS (SELECT offer_id, rung, min(product_id) AS product_id, count(DISTINCT product_id) AS n FROM r GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY rung) AS k FROM n) "
    "SELECT o.offer_id, CASE WHEN f.rung IS NULL THEN 'NO_MATCH' WHEN f.n > 1 AND f.rung IN (1, 3) THEN 'AMBIGUOUS' ELSE 'MATCH' END AS status, (['gtin', 'mpn_brand', 'manufacturer_sku', 'brand_model'])[f.rung + 1] AS strategy, ([1.0, 0.95, 0.9, 0.85]::DOUBLE[])[f.rung + 1] AS confidence, CASE WHEN f.n > 1 AND f.rung IN (1, 3) THEN NULL ELSE f.product_id END AS product_id FROM o LEFT JOIN f ON f.offer_id = o.offer_id AND f.k = 1"
)
def match_ladder(spark, sf_dir):
    return i.match(_offers(spark, sf_dir), _products(spark, sf_dir))


@query(f"WITH {_P}, {_O}, {_RUNGS}, s AS (SELECT offer_id, min(product_id) FILTER (WHERE rung = 0) AS by_gtin, min(product_id) FILTER (WHERE rung = 1) AS by_mpn FROM r WHERE rung < 2 GROUP BY 1) SELECT * FROM s WHERE by_gtin <> by_mpn")
def identity_conflict(spark, sf_dir):
    return i.conflicts(_offers(spark, sf_dir), _products(spark, sf_dir))


@query()
def fuzzy_candidates(spark, sf_dir):
    """Similar names within a brand; SQL has no such measure, the tests hold it against difflib."""
    return i.candidates(_offers(spark, sf_dir), _products(spark, sf_dir))


@query(f"WITH {_P}, {_O}, {_RUNGS}, n AS (SELECT offer_id, rung, count(DISTINCT product_id) AS n FROM r GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (PARTITION BY offer_id ORDER BY rung) AS k FROM n) SELECT CASE WHEN f.rung IS NULL THEN 'NO_MATCH' WHEN f.n > 1 AND f.rung IN (1, 3) THEN 'AMBIGUOUS' ELSE 'MATCH' END AS status, (['gtin', 'mpn_brand', 'manufacturer_sku', 'brand_model'])[f.rung + 1] AS strategy, count(*) AS n FROM o LEFT JOIN f ON f.offer_id = o.offer_id AND f.k = 1 GROUP BY ALL")
def match_breakdown(spark, sf_dir):
    return i.match(_offers(spark, sf_dir), _products(spark, sf_dir)).groupBy("status", "strategy").agg(F.count(F.lit(1)).alias("n"))


@query()
def match_ladder_similar(spark, sf_dir):
    """The ladder with its last rung: every seventh offer comes without keys, so that only their names can tell. The tests hold it against difflib over all pairs."""
    unkeyed = F.col("offer_id") % 7 == 0
    offers = _offers(spark, sf_dir)
    blank = [F.when(~unkeyed, F.col(c)).alias(c) if c in ("gtin", "mpn", "model", "sku") else F.col(c) for c in offers.columns]
    return i.match_or_similar(offers.select(*blank), _products(spark, sf_dir))
