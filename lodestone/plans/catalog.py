"""Queries of catalogue search, facets and the category tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import bindings as b
from lodestone.bindings import with_views
from lodestone.operators import catalog as c
from lodestone.registry import query

_MET = "SELECT p.id, p.name, p.brand, p.category, p.size, p.list_price, min(o.price) AS sort_price FROM products p JOIN offers o ON o.product_id = p.id WHERE {} GROUP BY ALL"
_PAGE = with_views("products", "offers") + ", met AS (" + _MET + ") SELECT * FROM met ORDER BY {} LIMIT {} OFFSET {}"


def _search(spark: SparkSession, sf_dir: str, **conditions) -> DataFrame:
    return c.search(b.products(spark, sf_dir), b.offers(spark, sf_dir), **conditions)


@query(_PAGE.format("p.name ILIKE '%widget%' AND (p.brand ILIKE 'brand#2' OR p.brand ILIKE 'brand#17' OR p.brand ILIKE 'brand#4') AND o.price BETWEEN 1000 AND 4000", "sort_price, id", 20, 0))
def search_filtered(spark, sf_dir):
    return c.paged(_search(spark, sf_dir, query="widget", brand="brand#2, Brand#17,brand#4", min_price=1000, max_price=4000))


@query(with_views("products", "offers") + ", met AS (" + _MET.format("p.name ILIKE '%red%'") + ") SELECT count(DISTINCT id) AS total FROM met")
def search_total(spark, sf_dir):
    return _search(spark, sf_dir, query="red").agg(F.count_distinct("id").alias("total"))


@query(_PAGE.format("(p.name ILIKE '%bolt%' OR p.brand ILIKE '%bolt%' OR p.category ILIKE '%bolt%') AND (p.name ILIKE '%smal%' OR p.brand ILIKE '%smal%' OR p.category ILIKE '%smal%')", "name, id", 50, 0))
def search_synonyms(spark, sf_dir):
    """bolts -> bolt, bolts; smalls -> smalls, small; with the idle word "para" left out."""
    return c.paged(_search(spark, sf_dir, query="bolts para smales"), order="name", limit=50)


@query(_PAGE.format("EXISTS (SELECT 1 FROM part s WHERE s.p_partkey = p.id AND s.p_type IN ('SMALL', 'LARGE'))", "sort_price DESC, id", 40, 0))
def search_spec_exists(spark, sf_dir):
    found = _search(spark, sf_dir, spec_values=b.spec_values(spark, sf_dir), options={"type": ["SMALL", "LARGE"]})
    return c.paged(found, order="price_desc", limit=40)


@query(with_views("products", "offers") + " " + _MET.format("EXISTS (SELECT 1 FROM part s WHERE s.p_partkey = p.id AND s.p_size BETWEEN 10 AND 20)"))
def search_spec_range(spark, sf_dir):
    """All that are found, without pages. A range that is upside down is no condition."""
    return _search(spark, sf_dir, spec_values=b.spec_values(spark, sf_dir), ranges={"size": "10-20", "brand": "9-1"})


@query(_PAGE.format("p.id IN (3, 17, 90, 55)", "id", 20, 0))
def search_by_ids(spark, sf_dir):
    return c.paged(_search(spark, sf_dir, ids="17,3,x,90,55"), order="ids")


@query(_PAGE.format("p.category = 'LARGE'", "id DESC", 25, 50))
def search_paged(spark, sf_dir):
    wanted = spark.createDataFrame([("LARGE",)], "name string")
    return c.paged(_search(spark, sf_dir, category=wanted), order="newest", limit=25, offset=50)


@query(with_views("products", "offers") + " SELECT count(DISTINCT o.product_id) AS total, min(o.price) AS min_price, max(o.price) AS max_price FROM offers o JOIN products p ON p.id = o.product_id")
def facet_summary(spark, sf_dir):
    return c.facet_summary(b.products(spark, sf_dir), b.offers(spark, sf_dir))


@query(with_views("products") + " SELECT brand, count(DISTINCT id) AS products FROM products GROUP BY brand ORDER BY products DESC, brand LIMIT 20")
def facet_brands(spark, sf_dir):
    return c.brand_facet(b.products(spark, sf_dir))


@query(with_views("spec_values", "definitions") + ", n AS (SELECT s.key, value_text, count(DISTINCT product_id) AS products FROM spec_values s JOIN definitions d ON d.key = s.key WHERE d.kind = 'text' AND value_text IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY products DESC, value_text)::INTEGER AS rank FROM n) SELECT * FROM r WHERE rank <= 15")
def facet_options(spark, sf_dir):
    return c.option_facet(b.spec_values(spark, sf_dir), b.definitions(spark))


@query(with_views("spec_values", "definitions") + " SELECT s.key, min(value_number) AS low, max(value_number) AS high FROM spec_values s JOIN definitions d ON d.key = s.key WHERE d.kind = 'number' GROUP BY s.key HAVING min(value_number) IS NOT NULL")
def facet_numeric(spark, sf_dir):
    return c.number_facet(b.spec_values(spark, sf_dir), b.definitions(spark))


_UP = with_views("tree", recursive=True) + ", up AS (SELECT id, id AS ancestor_id FROM tree UNION SELECT u.id, t.parent_id FROM up u JOIN tree t ON t.id = u.ancestor_id WHERE t.parent_id IS NOT NULL)"


@query(_UP + ", direct AS (SELECT s_nationkey + 1000 AS category_id, count(*) AS n FROM supplier GROUP BY 1) SELECT t.id, t.parent_id, t.name, coalesce(sum(d.n) FILTER (WHERE u.id = t.id), 0)::BIGINT AS products, coalesce(sum(d.n), 0)::BIGINT AS total_products FROM tree t JOIN up u ON u.ancestor_id = t.id LEFT JOIN direct d ON d.category_id = u.id GROUP BY t.id, t.parent_id, t.name")
def category_tree_counts(spark, sf_dir):
    members = b.stores(spark, sf_dir).select((F.col("nation_id") + 1000).cast("bigint").alias("category_id"))
    return c.tree_counts(b.tree(spark, sf_dir), members)


@query(_UP + " SELECT DISTINCT id FROM up WHERE ancestor_id = 102")
def category_subtree(spark, sf_dir):
    return c.subtree(b.tree(spark, sf_dir), 102)


@query(with_views("tree") + " SELECT name, parent_id, count(*) AS n FROM (SELECT * FROM tree UNION ALL SELECT id, parent_id, name, sort_order FROM tree WHERE id % 2 = 0) GROUP BY name, parent_id HAVING count(*) > 1")
def repeated_category_names(spark, sf_dir):
    tree = b.tree(spark, sf_dir)
    return c.repeated_names(tree.unionByName(tree.where("id % 2 = 0")))


_CMP = "max(CASE WHEN p_partkey = {0} THEN v END) AS p{0}"


@query("WITH v AS (SELECT p_partkey, 'size' AS key, p_size::DOUBLE::VARCHAR AS v FROM part WHERE p_size <= 45 UNION ALL SELECT p_partkey, 'type', p_type FROM part WHERE p_type <> 'PROMO' UNION ALL SELECT p_partkey, 'brand', p_brand FROM part) SELECT key, " + ", ".join(_CMP.format(i) for i in (1, 2, 5, 8)) + " FROM v WHERE p_partkey IN (1, 2, 5, 8) GROUP BY key")
def comparison_matrix(spark, sf_dir):
    return c.comparison(b.products(spark, sf_dir), b.spec_values(spark, sf_dir), [1, 2, 5, 8])


_CHAIN = "SELECT DISTINCT o_custkey AS id, CASE WHEN o_custkey % 500 > 0 THEN o_custkey - 1 WHEN o_custkey % 1000 = 500 THEN o_custkey + 9 END AS parent_id FROM {}"


@query(
    f"""WITH RECURSIVE t AS ({_CHAIN.format("orders")}), up AS (
        SELECT id, id AS ancestor_id, 0 AS distance FROM t UNION ALL
        SELECT up.id, t.parent_id, distance + 1 FROM up JOIN t ON t.id = up.ancestor_id WHERE t.parent_id IS NOT NULL AND distance < 600)
    SELECT id, min(ancestor_id) AS highest, max(distance) AS distance, count(*) AS n FROM (SELECT id, ancestor_id, min(distance) AS distance FROM up GROUP BY ALL) GROUP BY id"""
)
def category_closure(spark, sf_dir):
    """Customers with orders as chains of up to 500 levels, broken where one has none; some chains end in a cycle."""
    tree = spark.sql(_CHAIN.format("{o}"), o=b.table(spark, sf_dir, "orders"))
    return c.closure_totals(tree)
