"""Queries of what messages mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import bindings as b
from lodestone.bindings import with_views
from lodestone.operators import entities as e
from lodestone.registry import query

#: What order lines say of their part, in five forms: a reference, ids alone, a model of one brand beside another brand, words, a brand.
_SAID = """CASE l_linenumber % 5 WHEN 0 THEN 'y el segundo?' WHEN 1 THEN 'mira eso' WHEN 2 THEN concat('comparar ', p_brand, ' ', p_size, ' con Brand#', 1 + p_size % 25)
    WHEN 3 THEN concat('Busco un ', p_name, ' ', p_size) ELSE concat('algo de ', p_brand) END"""
_MESSAGE = "concat(l_orderkey, '/', l_linenumber, '/', l_partkey)"

_SQL = f"""{with_views("offers")}, least AS (SELECT product_id AS id, min(price) AS sort_price FROM offers GROUP BY 1),
cat AS (SELECT id, lower(p_brand) AS brand, sort_price, lower(concat(p_name, ' ', p_size, chr(10), p_brand, chr(10), p_type)) AS said FROM part JOIN least ON id = p_partkey),
m AS (SELECT DISTINCT {_MESSAGE} AS message_id, l_linenumber % 5 AS form, l_partkey AS k, lower({_SAID}) AS said FROM lineitem JOIN part ON p_partkey = l_partkey),
direct AS (SELECT message_id, 'reference' AS method, 1 AS rank, k + 1 AS product_id FROM m WHERE form = 0 AND k + 1 IN (SELECT id FROM cat)
    UNION ALL SELECT message_id, 'ids', row_number() OVER (PARTITION BY message_id ORDER BY p), k + p FROM (SELECT message_id, k, unnest([0, 7]) AS p FROM m WHERE form = 1) WHERE k + p IN (SELECT id FROM cat)),
w AS (SELECT message_id, form, string_split(said, ' ') AS t, said FROM m WHERE form > 1),
asked AS (SELECT message_id, 'terms' AS method, 1 AS kind, 1 AS place, t[2] || ' ' || t[3] AS q, t[2] AS brand FROM w WHERE form = 2
    UNION ALL SELECT message_id, 'terms', 2, 1, t[2], '' FROM w WHERE form = 2 UNION ALL SELECT message_id, 'terms', 2, 4, t[5], '' FROM w WHERE form = 2 AND t[5] <> t[2]
    UNION ALL SELECT message_id, 'terms', 2, 2, t[3], '' FROM w WHERE form = 4 UNION ALL SELECT message_id, 'message', 3, 0, array_to_string(t[3:], ' '), '' FROM w WHERE form = 3),
d AS (SELECT q, brand, list_filter(string_split(q, ' '), lambda x: length(x) > 1) AS t FROM asked GROUP BY 1, 2),
s AS (SELECT q, d.brand, id, row_number() OVER (PARTITION BY q, d.brand ORDER BY sort_price, id) AS n FROM d JOIN cat ON (d.brand = '' OR d.brand = cat.brand) AND contains(said, t[1]) AND (len(t) < 2 OR contains(said, t[2])) AND (len(t) < 3 OR contains(said, t[3]))),
b AS (SELECT message_id, method, id, min((kind, place, s.q, n)) AS place FROM asked JOIN s ON s.q = asked.q AND s.brand = asked.brand WHERE n <= 5 GROUP BY ALL)
SELECT message_id, method, rank::INTEGER AS rank, product_id FROM direct UNION ALL SELECT message_id, method, row_number() OVER (PARTITION BY message_id ORDER BY place, id)::INTEGER, id FROM b"""


@query(_SQL)
def resolved_products(spark, sf_dir):
    """Every order line as a message, against all parts that have an offer, cheapest first."""
    least = b.offers(spark, sf_dir).groupBy(F.col("product_id").alias("id")).agg(F.min("price").alias("sort_price"))
    named = b.products(spark, sf_dir).withColumn("name", F.concat_ws(" ", "name", "size")).select("id", "name", "brand", "category")
    part, form = F.col("l_partkey"), F.col("l_linenumber") % 5
    # Lines and parts are told apart by what messages take of them, before they meet: a row is a few numbers there.
    said_of = b.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size").distinct()
    lines = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct().join(said_of, F.col("p_partkey") == part)
    messages = lines.select(
        F.expr(_MESSAGE).alias("message_id"), F.expr(_SAID).alias("text"),
        F.when(form == 0, F.array(part, part + 1)).alias("active"), F.when(form == 1, F.array(part, part + 7, part)).alias("ids"),
    )
    return e.resolved(messages, named.join(least, "id"))
