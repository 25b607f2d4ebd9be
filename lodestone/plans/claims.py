"""Queries of evidence from several sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import bindings as b
from lodestone.operators import agreement as a
from lodestone.registry import query

#: What order lines say of their part: another variant on every fourth line and for some sizes, no model on the next; weights, memory or words by the part's size.
_TITLE = "CASE WHEN p_size % 16 = 5 OR l_linenumber % 4 = 0 THEN concat(upper(p_name), ' Pro') WHEN l_linenumber % 4 = 1 THEN concat('Sobre ', p_type) ELSE p_name END"
_CONTENT = """CASE WHEN p_size % 4 = 0 THEN concat('pesa ', CAST(p_size AS STRING), ' g')
    WHEN p_size % 4 = 1 THEN concat('trae ', CAST(CAST(floor(l_quantity / 40) AS INT) * 8 + 8 AS STRING), CASE WHEN l_linenumber > 3 THEN ' gigas' ELSE ' GB' END, ' y ', CAST(p_size AS STRING), ' GB')
    WHEN p_size % 4 = 2 THEN concat('muy ', CASE WHEN l_discount > 0.09 THEN 'mala' ELSE 'buena' END)
    ELSE concat(CAST(l_quantity AS INT), CASE WHEN l_tax > 0.04 THEN ' watts' ELSE ' mah' END) END"""


def _evidence(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem").join(b.table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return lines.select(F.col("l_partkey").alias("claim"), F.expr(_TITLE).alias("title"), F.expr(_CONTENT).alias("content"), (0.5 + F.col("l_discount")).alias("confidence"))


_SQL = f"""WITH c AS (SELECT p_partkey AS claim, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS model FROM part),
e AS (SELECT row_number() OVER () AS item, l_partkey AS claim, model, lower({_TITLE.replace("STRING", "VARCHAR")} || ' ' || {_CONTENT.replace("STRING", "VARCHAR")}) AS said, 0.5::DOUBLE + l_discount AS sure
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN c ON claim = l_partkey),
w AS (SELECT *, regexp_extract_all(lower(model), '[a-z0-9]+') AS own, regexp_extract_all(said, '[a-z0-9]+') AS words FROM e),
k AS (SELECT *, CASE WHEN model = '' THEN 1 WHEN NOT list_has_any(own, words) THEN 0 WHEN list_has_all(words, own)
    AND NOT list_has_any({list(a.VARIANT_WORDS)}, list_filter(words, lambda x: NOT list_contains(own, x))) THEN 1 ELSE 2 END AS kind FROM w),
q AS (SELECT claim, item, unnest(regexp_extract_all(said, '([0-9]+)\\s*([a-z]+)', 1))::DOUBLE AS value, unnest(regexp_extract_all(said, '([0-9]+)\\s*([a-z]+)', 2)) AS name FROM k WHERE kind = 1),
u AS (SELECT claim, item, value, CASE name WHEN 'gigas' THEN 'gb' WHEN 'watts' THEN 'w' ELSE name END AS unit FROM q),
p AS (SELECT x.claim, bool_or(x.value = y.value) AS same FROM u x JOIN u y ON y.claim = x.claim AND y.unit = x.unit AND x.item < y.item GROUP BY x.claim, x.item, y.item, x.unit),
s AS (SELECT claim, count(*) FILTER (WHERE kind = 1) AS items, count(*) FILTER (WHERE kind = 2) AS mismatched, max(sure) FILTER (WHERE kind = 1) AS base, count(DISTINCT said) FILTER (WHERE kind = 1) AS texts,
    count(*) FILTER (WHERE kind = 1 AND item IN (SELECT item FROM u)) AS numeric FROM k GROUP BY 1)
SELECT c.claim, c.model, coalesce(items, 0) AS items, coalesce(mismatched, 0) AS mismatched,
    CASE WHEN coalesce(items, 0) = 0 THEN CASE WHEN mismatched > 0 THEN 'variant_mismatch' ELSE 'insufficient_evidence' END WHEN c.claim IN (SELECT claim FROM p WHERE NOT same) THEN 'conflict'
        WHEN numeric > 0 OR texts = 1 THEN 'agreement' ELSE 'insufficient_evidence' END AS verdict,
    round(CASE WHEN coalesce(items, 0) = 0 OR c.claim IN (SELECT claim FROM p WHERE NOT same) THEN 0.0::DOUBLE WHEN numeric > 0 THEN least(0.95::DOUBLE, base + 0.15::DOUBLE * (numeric - 1)) WHEN texts = 1 THEN least(0.9::DOUBLE, base) ELSE 0.0::DOUBLE END, 2) AS confidence
FROM c LEFT JOIN s ON s.claim = c.claim"""


@query(_SQL)
def claim_verdicts(spark, sf_dir):
    """Every part is a claim, on even keys about its own name as model; every order line is an item of evidence."""
    claims = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("claim"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("model"))
    return a.classified(_evidence(spark, sf_dir), claims)
