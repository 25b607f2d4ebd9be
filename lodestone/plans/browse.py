"""Queries of browsing. A product's category is one of the nations' leaves, by its key."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import bindings as b
from lodestone.bindings import with_views
from lodestone.functions.text import slug
from lodestone.operators import browse
from lodestone.operators import catalog as c
from lodestone.registry import query

_SLUG = "regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
_TREE = with_views("tree", "products", "offers", "spec_values", recursive=True) + (
    f", named AS (SELECT *, {_SLUG} AS slug FROM tree), placed AS (SELECT *, 1000 + id % 25 AS category_id FROM products), "
    "below(id) AS (SELECT id FROM named WHERE {} UNION SELECT t.id FROM named t JOIN below ON t.parent_id = below.id), "
    "met AS (SELECT p.id, p.name, p.brand, p.category_id, min(o.price) AS sort_price FROM placed p JOIN offers o ON o.product_id = p.id WHERE p.category_id IN (SELECT id FROM below) AND {} GROUP BY ALL)"
)


def _tree(spark, sf_dir):
    return b.tree(spark, sf_dir).withColumn("slug", slug(F.col("name")))


def _placed(spark, sf_dir):
    return b.products(spark, sf_dir).withColumn("category_id", 1000 + F.col("id") % 25)


def _found(spark, sf_dir, term: str, **conditions):
    return browse.search_below(_placed(spark, sf_dir), b.offers(spark, sf_dir), _tree(spark, sf_dir), term, **conditions).select("id", "name", "brand", "category_id", "sort_price")


@query(_TREE.format("slug = 'middle-east'", "p.name ILIKE '%ring%'") + " SELECT * FROM met ORDER BY sort_price, id LIMIT 40")
def category_search(spark, sf_dir):
    """By a group's slug: all leaves below it."""
    return c.paged(_found(spark, sf_dir, "middle-east", query="ring"), limit=40)


@query(_TREE.format("name = 'MIDDLE EAST'", "o.price >= 2000") + " SELECT * FROM met ORDER BY name, id LIMIT 40")
def category_search_by_name(spark, sf_dir):
    return c.paged(_found(spark, sf_dir, "MIDDLE EAST", min_price=2000), order="name", limit=40)


@query(_TREE.format("id = (SELECT min(id) FROM named WHERE list_contains(string_split(lower(name), ' '), 'africa'))", "true") + " SELECT count(*) AS total, min(category_id) AS first_category, max(category_id) AS last_category FROM met")
def category_search_by_synonym(spark, sf_dir):
    """A plural that is neither a slug nor a name."""
    return _found(spark, sf_dir, "Africas").agg(F.count(F.lit(1)).alias("total"), F.min("category_id").alias("first_category"), F.max("category_id").alias("last_category"))


@query(_TREE.format("false", "true") + " SELECT * FROM met")
def category_search_unknown(spark, sf_dir):
    """A term that means no category finds nothing."""
    return _found(spark, sf_dir, "no such category")


_DEFINITIONS = "SELECT * FROM (VALUES (1, 'size', 'number', 1), (2, 'kind', 'text', 2), (3, 'kind', 'text', 3), (4, 'maker', 'text', 4)) AS d(definition_id, key, kind, sort_order)"
_VALUES = "SELECT product_id, CASE key WHEN 'size' THEN 1 WHEN 'type' THEN 2 + product_id % 2 ELSE 4 END AS definition_id, value_number, value_text FROM spec_values"
_FACETS = _TREE.format("slug = 'europe'", "p.name ILIKE '%red%'") + (
    f", d AS ({_DEFINITIONS}), v AS ({_VALUES}), first AS (SELECT key, arg_min(definition_id, sort_order) AS definition_id, arg_min(kind, sort_order) AS kind FROM d GROUP BY key), "
    "own AS (SELECT {}, f.kind, v.* FROM v JOIN d ON d.definition_id = v.definition_id JOIN first f ON f.key = d.key {} WHERE v.product_id IN (SELECT id FROM met)), "
    "t AS (SELECT key, value_text AS value, count(DISTINCT product_id) AS products FROM own WHERE kind = 'text' AND value_text IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY products DESC, value)::INTEGER AS rank FROM t) "
    "SELECT key, 'options' AS kind, value, products, NULL::DOUBLE AS low, NULL::DOUBLE AS high, rank FROM r WHERE rank <= 15 UNION ALL "
    "SELECT key, 'range', NULL, count(DISTINCT product_id), min(value_number), max(value_number), NULL FROM own WHERE kind = 'number' AND value_number IS NOT NULL GROUP BY key"
)


def _facets(spark, sf_dir, **how):
    values = b.spec_values(spark, sf_dir).select("product_id", F.when(F.col("key") == "size", 1).when(F.col("key") == "type", (2 + F.col("product_id") % 2).cast("int")).otherwise(4).alias("definition_id"), "value_number", "value_text")
    return browse.facets(_found(spark, sf_dir, "europe", query="red"), values, spark.sql(_DEFINITIONS), **how)


@query(_FACETS.format("d.key", "AND f.definition_id = d.definition_id"))
def facets_below(spark, sf_dir):
    """Facets of a filtered set; of two definitions with one key the first counts."""
    return _facets(spark, sf_dir)


@query(_FACETS.format("d.key", ""))
def facets_below_merged(spark, sf_dir):
    return _facets(spark, sf_dir, merge_keys=True)


@query(with_views("tree") + " SELECT id, name, sort_order FROM tree ORDER BY sort_order, name, id")
def category_list(spark, sf_dir):
    return browse.listed(b.tree(spark, sf_dir)).select("id", "name", "sort_order")
