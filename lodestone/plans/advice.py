"""Queries of advice: recommendations by use case, summaries, sections of evidence, result pages, lists and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import bindings as b
from lodestone.bindings import with_views
from lodestone.operators import advice as a
from lodestone.operators import catalog, evidence
from lodestone.plans.quality import _EVIDENCE, _evidence
from lodestone.registry import query

_CRITERIA = a.weights_for(["gaming", "battery"], ["RAM", "Peso"])
_PART_VALUES = (
    "SELECT p_type AS group_id, p_partkey AS product_id, 'RAM' AS label, CASE WHEN p_size % 5 > 0 THEN p_size::DOUBLE END AS number FROM part UNION ALL SELECT p_type, p_partkey, 'Peso', (p_partkey % 9 - 4)::DOUBLE FROM part "
    "UNION ALL SELECT p_type, p_partkey, 'price', p_retailprice::DOUBLE FROM part UNION ALL SELECT p_type, p_partkey, 'gaming', CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 100)::DOUBLE END FROM part"
)
_SIDE = "CASE label WHEN 'Peso' THEN -number WHEN 'price' THEN -number ELSE number END"


def _values(spark, sf_dir):
    """Sizes, keys and prices of parts as values of four labels."""
    part = b.table(spark, sf_dir, "part")
    stack = "stack(4, 'RAM', if(p_size % 5 > 0, cast(p_size as double), null), 'Peso', cast(p_partkey % 9 - 4 as double), 'price', cast(p_retailprice as double), 'gaming', if(p_partkey % 3 > 0, cast(p_partkey % 100 as double), null)) as (label, number)"
    return part.select(F.col("p_type").alias("group_id"), F.col("p_partkey").alias("product_id"), F.expr(stack))


@query(
    "WITH c AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{label}', {a.WEIGHT_VALUES[w]}::DOUBLE)" for i, (label, w) in enumerate(_CRITERIA.items())) + f") AS c(place, label, weight)), v AS ({_PART_VALUES}), "
    f"g AS (SELECT v.*, weight, {_SIDE.replace('label', 'v.label')} AS grade FROM v JOIN c ON c.label = v.label WHERE number IS NOT NULL), t AS (SELECT group_id, label, max(grade) AS best, count(*) AS known FROM g GROUP BY ALL), "
    "s AS (SELECT g.group_id, product_id, sum(CASE WHEN best > 0 THEN grade / best * weight ELSE 0 END) AS score FROM g JOIN t ON t.group_id = g.group_id AND t.label = g.label GROUP BY ALL), "
    "p AS (SELECT p_type AS group_id, p_partkey AS product_id, p_retailprice <= 950 AS cheap, count(*) FILTER (WHERE p_retailprice <= 950) OVER (PARTITION BY p_type) AS n_cheap FROM part), "
    "w AS (SELECT p.group_id, p.product_id, round(coalesce(score, 0), 6) AS score FROM p LEFT JOIN s ON s.group_id = p.group_id AND s.product_id = p.product_id WHERE cheap OR n_cheap = 0 QUALIFY row_number() OVER (PARTITION BY p.group_id ORDER BY round(coalesce(score, 0), 6) DESC, p.product_id) = 1), "
    "n AS (SELECT group_id, count(*) AS n FROM p GROUP BY 1), e AS (SELECT n.group_id, n, c.place, c.label, coalesce(known, 0) AS known FROM n CROSS JOIN c LEFT JOIN t ON t.group_id = n.group_id AND t.label = c.label), "
    "f AS (SELECT group_id, round(least(0.95::DOUBLE, 0.4::DOUBLE + 0.55::DOUBLE * (sum(known)::DOUBLE / sum(n)::DOUBLE)), 3) AS confidence, list(label ORDER BY place) FILTER (WHERE known < n) AS unknowns FROM e GROUP BY 1) "
    "SELECT w.group_id, product_id, score, confidence, array_to_string(unknowns, ',') AS unknowns FROM w JOIN f ON f.group_id = w.group_id"
)
def advised_for_use(spark, sf_dir):
    """The part of each type for games and a long charge, of at most 950 where there is one."""
    products = b.table(spark, sf_dir, "part").select(F.col("p_type").alias("group_id"), F.col("p_partkey").alias("product_id"), F.col("p_retailprice").alias("price"))
    return a.advised(products, _values(spark, sf_dir), _CRITERIA, 950).withColumn("unknowns", F.array_join("unknowns", ","))


@query(f"WITH v AS ({_PART_VALUES}), g AS (SELECT *, {_SIDE} AS grade FROM v WHERE number IS NOT NULL) SELECT group_id, label, product_id FROM g QUALIFY row_number() OVER (PARTITION BY group_id, label ORDER BY grade DESC, product_id) = 1")
def advice_strengths(spark, sf_dir):
    return a.strengths(_values(spark, sf_dir))


_ITEMS = (
    "SELECT p_partkey AS product_id, 1 AS place, 'Memoria' AS label, p_size || ' GB' AS value FROM part UNION ALL SELECT p_partkey, 2, 'memoria', CASE WHEN p_size % 3 = 0 THEN '' ELSE p_size % 4 || ' GB' END FROM part "
    "UNION ALL SELECT p_partkey, 3, 'MEMORIA ', p_size || ' GB DDR' || p_size % 2 FROM part UNION ALL SELECT p_partkey, 4, 'Frecuencias core', 1000 + p_size || ' MHz' FROM part UNION ALL SELECT p_partkey, 5, 'Frecuencias Core', 1000 + p_size % 7 * 7 || ' mhz' FROM part"
)
_MERGE = (
    "CASE WHEN contains(lower(x), lower(y)) THEN x WHEN contains(lower(y), lower(x)) THEN y "
    "WHEN key = 'frecuencias core' AND regexp_extract(x, '([0-9]+)', 1) <> regexp_extract(y, '([0-9]+)', 1) THEN regexp_extract(x, '([0-9]+)', 1) || ' / ' || regexp_extract(y, '([0-9]+)', 1) || ' MHz' "
    "WHEN len(list_filter(string_split(x, ' / '), lambda p: contains(lower(y), lower(p)) OR contains(lower(p), lower(y)))) > 0 THEN x ELSE x || ' / ' || y END"
)


@query(
    f"WITH i AS (SELECT * FROM ({_ITEMS}) WHERE trim(value) <> ''), o AS (SELECT *, lower(trim(label)) AS key, row_number() OVER (PARTITION BY product_id, lower(trim(label)) ORDER BY place) AS n FROM i), "
    f"one AS (SELECT product_id, key, label, value AS x FROM o WHERE n = 1), two AS (SELECT one.product_id, one.key, one.label, CASE WHEN y IS NULL THEN x ELSE {_MERGE} END AS x FROM one LEFT JOIN (SELECT product_id, key, value AS y FROM o WHERE n = 2) AS s ON s.product_id = one.product_id AND s.key = one.key), "
    f"three AS (SELECT two.product_id, two.label, CASE WHEN y IS NULL THEN x ELSE {_MERGE.replace('key', 'two.key')} END AS value FROM two LEFT JOIN (SELECT product_id, key, value AS y FROM o WHERE n = 3) AS s ON s.product_id = two.product_id AND s.key = two.key) SELECT * FROM three".replace("WHEN key =", "WHEN one.key =")
)
def summary_items(spark, sf_dir):
    """Sizes and speeds of parts under labels in several spellings."""
    part = b.table(spark, sf_dir, "part")
    stack = (
        "stack(5, 1, 'Memoria', concat(p_size, ' GB'), 2, 'memoria', if(p_size % 3 = 0, '', concat(p_size % 4, ' GB')), 3, 'MEMORIA ', concat(p_size, ' GB DDR', p_size % 2), "
        "4, 'Frecuencias core', concat(1000 + p_size, ' MHz'), 5, 'Frecuencias Core', concat(1000 + p_size % 7 * 7, ' mhz')) as (place, label, value)"
    )
    return a.summary(part.select(F.col("p_partkey").alias("product_id"), F.expr(stack)))


@query(
    f"WITH {_EVIDENCE}, i AS (SELECT * FROM evidence WHERE value IS NOT NULL), z AS (SELECT claim, value, count(*) AS n FROM i GROUP BY ALL), m AS (SELECT claim, value AS top, count(*) OVER (PARTITION BY claim) AS variants FROM z QUALIFY row_number() OVER (PARTITION BY claim ORDER BY n DESC, value) = 1), "
    "l AS (SELECT i.claim, value = top AS supports, '  · ' || CASE WHEN value = top THEN 'apoya ' ELSE 'en contra ' END || CASE WHEN source = 'web' THEN 'web' ELSE '[' || source || '](https://' || source || '.example/' || value || ')' END AS line FROM i JOIN m ON m.claim = i.claim), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY supports DESC, line) AS n FROM l), t AS (SELECT claim, string_agg(line, chr(10) ORDER BY n) AS lines FROM r WHERE n <= 20 GROUP BY 1) "
    "SELECT e.claim, '- ' || e.claim || ': ' || CASE WHEN variants IS NULL THEN 'sin confirmar' WHEN variants = 1 THEN 'apoya' ELSE 'CONFLICTO' END || coalesce(chr(10) || lines, '') AS section FROM (SELECT DISTINCT claim FROM evidence) AS e LEFT JOIN m ON m.claim = e.claim LEFT JOIN t ON t.claim = e.claim"
)
def grounded_sections(spark, sf_dir):
    """Claims of (user, event type) with their sources; the value that most items state is the supported one."""
    rows = _evidence(spark, sf_dir)
    items = rows.where("value is not null")
    sizes = items.groupBy("claim", "value").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("claim").agg(F.min(F.struct((-F.col("n")).alias("minus"), "value")).alias("t")).select("claim", F.col("t.value").alias("top"))
    url = F.when(F.col("source") != "web", F.concat(F.lit("https://"), "source", F.lit(".example/"), "value"))
    told = items.join(top, "claim").select("claim", (F.col("value") == F.col("top")).alias("supports"), F.col("source").alias("source_name"), url.alias("source_url"))
    return a.sections(told, evidence.verdicts(rows).select("claim", "verdict"))


@query(
    "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"[^>]*>', 1)[1:5]) AS url, unnest(regexp_extract_all(html, '(?s)<a href=\"[^\"]*\"[^>]*>(.*?)</a>', 1)[1:5]) AS t FROM pages) "
    "SELECT page_id, trim(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS title, url, count(*) AS n FROM l WHERE trim(regexp_replace(t, '<[^>]*>', ' ', 'g')) <> '' AND url <> '' GROUP BY ALL"
)
def result_pages(spark, sf_dir):
    """The links of each page put as results whose addresses are packed into a redirect."""
    packed = F.regexp_replace("html", '<a href="([^"]*)"', '<a class="result__a" href="/l/?x=1&amp;uddg=$1"')
    found = b.table(spark, sf_dir, "pages").select("page_id", F.explode(a.search_results(packed)).alias("r"))
    return found.groupBy("page_id", "r.title", "r.url").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, greatest(1000 + p_size, CASE WHEN p_size % 2 = 0 THEN 900 + p_partkey % 300 ELSE 0 END) AS boost FROM part")
def largest_speed(spark, sf_dir):
    """Speeds of parts in two modes, beside one that counts for none."""
    said = F.concat(F.lit("Base 9999 MHz. Boost Clock: up to "), F.col("p_size") + 1000, F.lit(" MHz; "), F.when(F.col("p_size") % 2 == 0, F.lit("OC mode - ")).otherwise("idle "), F.col("p_partkey") % 300 + 900, F.lit("MHz"))
    return b.table(spark, sf_dir, "part").select("p_partkey", a.largest_stated(said, ("OC mode", "Default mode", "Boost Clock"), "MHz").alias("boost"))


_ASKED = [42, 7, 999, 3, 150]


@query(with_views("products") + f" SELECT id, name, list_position({_ASKED}, id) AS place FROM products WHERE id IN ({', '.join(map(str, _ASKED))})")
def compare_order(spark, sf_dir):
    return a.in_order(b.products(spark, sf_dir), _ASKED).select("id", "name", "place")


@query(
    with_views("tree", recursive=True) + ", up AS (SELECT id, id AS at, lower(name) AS path FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.id, t.id, up.path || '/' || lower(t.name) FROM up JOIN tree t ON t.parent_id = up.id) "
    "SELECT t.id, regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') AS slug, (SELECT count(*) FROM tree c WHERE c.parent_id = t.id) > 0 AS is_group, len(string_split(path, '/')) AS depth FROM tree t JOIN up ON up.id = t.id"
)
def taxonomy_nodes(spark, sf_dir):
    """The tree flat: slug, depth, and whether a node is a group or a leaf."""
    tree = b.tree(spark, sf_dir)
    depths = catalog.ancestors(tree).groupBy("id").agg(F.count(F.lit(1)).alias("depth"))
    groups = tree.select(F.col("parent_id").alias("_g")).where("_g is not null").distinct()
    return tree.join(depths, "id").join(groups, F.col("id") == F.col("_g"), "left").select("id", F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-").alias("slug"), F.col("_g").isNotNull().alias("is_group"), "depth")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_acctbal > 0 AND s_nationkey % 2 = 0")
def synced_stores(spark, sf_dir):
    """Stores that are to be read and have an interval."""
    stores = b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") > 0).alias("sync_enabled"), F.when(F.col("s_nationkey") % 2 == 0, 60).alias("sync_interval"))
    return stores.where("sync_enabled and sync_interval is not null").select("id")


@query(with_views("products", "offers") + " SELECT id FROM products WHERE id IN (SELECT product_id FROM offers WHERE available)")
def products_offered(spark, sf_dir):
    offers = b.offers(spark, sf_dir).where("available").select(F.col("product_id").alias("id"))
    return b.products(spark, sf_dir).select("id").join(offers, "id", "left_semi")


@query(with_views("products", "offers", "observations") + " SELECT p.brand, count(*) AS readings, min(h.price) AS low, max(h.price) AS high FROM observations h JOIN offers o ON o.product_id = h.product_id AND o.store_id = h.store_id JOIN products p ON p.id = o.product_id GROUP BY 1")
def price_audit(spark, sf_dir):
    """Readings, their offers and products: counted per offer before they meet the products."""
    key = ["product_id", "store_id"]
    per = b.observations(spark, sf_dir).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("low"), F.max("price").alias("high"))
    met = per.join(b.offers(spark, sf_dir).select(*key), key).groupBy("product_id").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    named = met.join(b.products(spark, sf_dir).select("id", "brand"), F.col("product_id") == F.col("id"))
    return named.groupBy("brand").agg(F.sum("n").alias("readings"), F.min("low").alias("low"), F.max("high").alias("high"))


@query(with_views("products") + " SELECT id AS product_id, 'internal' AS store, 'internal://products/' || id AS url, list_price AS price, 'CLP' AS currency FROM products")
def internal_offers(spark, sf_dir):
    """New products keep their stated price as an offer of the internal store."""
    return b.products(spark, sf_dir).select(F.col("id").alias("product_id"), F.lit("internal").alias("store"), F.concat(F.lit("internal://products/"), "id").alias("url"), F.col("list_price").alias("price"), F.lit("CLP").alias("currency"))


def _mock(batches):
    """Stands for a model: it answers offers of an even key with the first candidate and leaves out every tenth."""
    import pandas as pd

    for asked in batches:
        known = asked[asked["offer_id"] % 10 != 0]
        even = known["offer_id"] % 2 == 0
        yield pd.DataFrame({"offer_id": known["offer_id"], "decision": even.map({True: "MATCHED", False: "NEW"}), "product_id": known["candidate"].where(even).astype("Int64"), "confidence": even.map({True: 0.8, False: 0.6}), "reason": "mock decision"})


@query(
    "SELECT o_orderkey AS offer_id, CASE WHEN o_orderkey % 10 = 0 THEN 'AMBIGUOUS' WHEN o_orderkey % 2 = 0 THEN 'MATCHED' ELSE 'NEW' END AS decision, CASE WHEN o_orderkey % 10 > 0 AND o_orderkey % 2 = 0 THEN o_custkey END AS product_id, "
    "CASE WHEN o_orderkey % 10 = 0 THEN 0.0 WHEN o_orderkey % 2 = 0 THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence, CASE WHEN o_orderkey % 10 = 0 THEN 'no answer' ELSE 'mock decision' END AS reason FROM orders"
)
def model_answers(spark, sf_dir):
    """Orders as offers with one candidate each, put to an injected model."""
    asked = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("offer_id"), F.col("o_custkey").cast("bigint").alias("candidate"))
    return a.answered(asked, _mock)
