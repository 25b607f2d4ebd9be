"""The engine's entities as views of the supplied tables, in DataFrame form and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, brand, category, size, list_price."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.col("p_size").alias("size"), F.floor("p_retailprice").cast("bigint").alias("list_price"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price observations: product_id, store_id, price (whole pesos, in steps of 100), observed_at, order_id, line_no, available."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("store_id"),
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity") / F.lit(100.0)) * 100).cast("bigint").alias("price"),
        F.col("l_shipdate").alias("observed_at"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        (F.col("l_linestatus") == "O").alias("available"),
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last observation of each product in each store, with the currency CLP."""
    last = F.max(F.struct("observed_at", "order_id", "line_no", "price", "available")).alias("last")
    seen = observations(spark, sf_dir).groupBy("product_id", "store_id").agg(last)
    return seen.select("product_id", "store_id", "last.price", "last.available", "last.observed_at", F.lit("CLP").alias("currency"))


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, nation_id."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation_id"))


def definitions(spark: SparkSession) -> DataFrame:
    """Specification definitions: key, kind, sort_order."""
    return spark.createDataFrame([("size", "number", 1), ("type", "text", 2), ("brand", "text", 3)], "key string, kind string, sort_order int")


def spec_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products unpivoted: product_id, key, value_number, value_text. A type that is PROMO counts as not stated, as does a size over 45."""
    part = table(spark, sf_dir, "part")
    stack = F.expr("stack(3, 'size', cast(p_size as double), cast(null as string), 'type', cast(null as double), p_type, 'brand', cast(null as double), p_brand) as (key, value_number, value_text)")
    rows = part.select(F.col("p_partkey").alias("product_id"), stack)
    return rows.where("not (key = 'type' and value_text = 'PROMO') and not (key = 'size' and value_number > 45)")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category tree: a root, regions as groups, nations as leaves: id, parent_id, name, sort_order."""
    root = spark.createDataFrame([(0, None, "WORLD", 0)], "id bigint, parent_id bigint, name string, sort_order int")
    groups = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("parent_id"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("int").alias("sort_order"))
    leaves = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1000).cast("bigint").alias("id"), (F.col("n_regionkey") + 100).cast("bigint").alias("parent_id"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("int").alias("sort_order"))
    return root.unionByName(groups).unionByName(leaves)


#: The same views for SQL; a query names those it needs.
SQL = {
    "products": "SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS category, p_size AS size, CAST(floor(p_retailprice) AS BIGINT) AS list_price FROM part",
    "observations": "SELECT l_partkey AS product_id, l_suppkey AS store_id, CAST(floor(l_extendedprice / l_quantity / 100.0::DOUBLE) * 100 AS BIGINT) AS price, l_shipdate AS observed_at, l_orderkey AS order_id, l_linenumber AS line_no, l_linestatus = 'O' AS available FROM lineitem",
    "offers": "SELECT product_id, store_id, price, available, observed_at, 'CLP' AS currency FROM (SELECT *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY observed_at DESC, order_id DESC, line_no DESC, price DESC, available DESC) AS n FROM observations) WHERE n = 1",
    "stores": "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation_id FROM supplier",
    "definitions": "SELECT * FROM (VALUES ('size', 'number', 1), ('type', 'text', 2), ('brand', 'text', 3)) AS t(key, kind, sort_order)",
    "spec_values": "SELECT p_partkey AS product_id, 'size' AS key, p_size::DOUBLE AS value_number, NULL::VARCHAR AS value_text FROM part WHERE p_size <= 45 UNION ALL SELECT p_partkey, 'type', NULL, p_type FROM part WHERE p_type <> 'PROMO' UNION ALL SELECT p_partkey, 'brand', NULL, p_brand FROM part",
    "tree": "SELECT 0::BIGINT AS id, NULL::BIGINT AS parent_id, 'WORLD' AS name, 0 AS sort_order UNION ALL SELECT r_regionkey + 100, 0, r_name, r_regionkey FROM region UNION ALL SELECT n_nationkey + 1000, n_regionkey + 100, n_name, n_nationkey FROM nation",
}


def with_views(*names: str, recursive: bool = False) -> str:
    """WITH clause for the views, and those they need."""
    need = list(dict.fromkeys([x for n in names for x in (("observations", n) if n == "offers" else (n,))]))
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(f"{n} AS ({SQL[n]})" for n in need)
