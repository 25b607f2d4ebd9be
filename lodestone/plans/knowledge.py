"""Queries of the knowledge base, of candidate lists, and of readers and upkeep operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import bindings as b
from lodestone.operators import admin, identity, ingest, research, specs
from lodestone.operators import knowledge as k
from lodestone.plans.identity import _O, _P, _offers, _products
from lodestone.registry import query

_VECTOR = [1.0, -0.5, 0.25, 0.75]
_DOT = " + ".join(f"embedding[{i + 1}]::DOUBLE * {x}" for i, x in enumerate(_VECTOR))
_NORM = "sqrt(" + " + ".join(f"(embedding[{i + 1}]::DOUBLE)**2" for i in range(4)) + f") * sqrt({sum(x * x for x in _VECTOR)}::DOUBLE)"


@query(
    f"WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, ({_DOT}) / ({_NORM}) AS semantic FROM documents JOIN embeddings ON vec_id = doc_id), s AS (SELECT doc_id, round((contains(t, 'house')::INTEGER + contains(t, 'tion')::INTEGER + contains(t, 'ment')::INTEGER) / 3::DOUBLE, 6) AS keyword, round(semantic, 6) AS semantic FROM d WHERE contains(t, 'house') OR contains(t, 'tion') OR contains(t, 'ment')), "
    "p AS (SELECT * FROM (SELECT * FROM s WHERE keyword > 0 ORDER BY keyword DESC, doc_id LIMIT 20) UNION SELECT * FROM (SELECT * FROM s WHERE semantic >= 0.05 ORDER BY semantic DESC, doc_id LIMIT 20)) "
    "SELECT *, round(0.35::DOUBLE * CASE WHEN semantic >= 0.05 THEN semantic ELSE 0 END + 0.2::DOUBLE * keyword, 6) AS score FROM p ORDER BY score DESC, doc_id LIMIT 10"
)
def hybrid_vectors(spark, sf_dir):
    """Words of the documents and the first four components of the vectors of the same ids."""
    vectors = b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_id"), F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double")).alias("vector"))
    docs = b.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")).join(vectors, F.col("doc_id") == F.col("_id")).drop("_id")
    return k.hybrid(docs, ["house", "tion", "ment"], _VECTOR, 10)


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src3') AND lang = 'en' AND text ILIKE '%the %'")
def document_filters(spark, sf_dir):
    docs = b.table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract("source", "([0-9]+)", 1).cast("int").alias("product_id"), "lang", F.col("text").alias("brand"))
    return k.documents_where(docs, product_ids=[1, 3], product_id=2, brand="the ", lang="en").select("doc_id")


@query("SELECT doc_id FROM documents WHERE text ILIKE '%anne%' OR text ILIKE '%lich%' OR source ILIKE '%anne%' OR source ILIKE '%lich%'")
def word_candidates(spark, sf_dir):
    return k.with_some_word(b.table(spark, sf_dir, "documents"), ["anne", "lich"], "text", "source").select("doc_id")


@query()
def model_candidates(spark, sf_dir):
    """Candidates by part number, by model and by similar names; SQL has no such measure of names, the tests hold the result against brute force."""
    return k.model_candidates(_offers(spark, sf_dir), _products(spark, sf_dir))


@query("WITH t AS (SELECT o_custkey AS offer_id, list_sort(list_distinct(list(CAST(o_orderkey AS BIGINT)))) AS c FROM orders GROUP BY 1) SELECT offer_id, substr(sha256('{\"candidates\":[' || array_to_string(c, ',') || '],\"offer\":' || offer_id || '}'), 1, 32) AS cache_key FROM t")
def candidate_cache_keys(spark, sf_dir):
    per = b.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("offer_id")).agg(F.collect_set(F.col("o_orderkey").cast("bigint")).alias("c"))
    return per.select("offer_id", k.cache_key(F.col("offer_id"), F.col("c")).alias("cache_key"))


@query("SELECT c_custkey AS offer_id, c_custkey % 3 = 0 AND c_custkey % 2 = 0 AS ask FROM customer")
def model_gate(spark, sf_dir):
    rungs = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("offer_id"), F.when(F.col("c_custkey") % 3 == 0, "AMBIGUOUS").otherwise("MATCH").alias("status"), F.when(F.col("c_custkey") % 2 == 0, "fuzzy_high").otherwise("mpn").alias("strategy"))
    return k.ask_model(rungs).select("offer_id", "ask")


@query("SELECT l_orderkey AS group_id, l_shipmode AS label, count(DISTINCT l_partkey) AS products FROM (SELECT *, CAST(l_linenumber % 3 AS VARCHAR) AS l_shipmode FROM lineitem) WHERE l_discount > 0 GROUP BY ALL HAVING count(DISTINCT l_partkey) >= 2")
def common_labels(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), F.col("l_partkey").alias("product_id"), (F.col("l_linenumber") % 3).cast("string").alias("label"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("number"))
    return k.common_labels(rows)


_BENCH = "concat('Geekbench ', CAST(5 + p_partkey % 2 AS STRING), ' single-core: ', CAST(1000 + p_size * 10 AS STRING), '; multi core ', CAST(5000 + p_size AS STRING), ' ', p_name)"


@query(f"WITH t AS (SELECT p_brand AS name, {_BENCH} AS s FROM part), x AS (SELECT name, regexp_extract(s, 'Geekbench ([0-9])', 1) AS version, 'single' AS kind, regexp_extract(s, 'single-core: ([0-9]+)', 1)::INTEGER AS score FROM t UNION ALL SELECT name, NULL, 'multi', regexp_extract(s, 'multi core ([0-9]+)', 1)::INTEGER FROM t) SELECT name, version, kind, count(*) AS n, min(score) AS low, max(score) AS high FROM x GROUP BY ALL")
def benchmark_groups(spark, sf_dir):
    read = b.table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.explode(research.benchmark_scores(F.expr(_BENCH))).alias("s"))
    return k.benchmark_groups(read.select("name", "s.version", "s.kind", "s.score"))


@query("SELECT p_partkey AS id, list_sort(CASE WHEN p_partkey % 2 = 0 THEN list_filter(['brand', 'size', 'type', 'weight'], lambda x: x <> p_type AND x IN ('size', 'weight') AND NOT (p_size > 25 AND x = 'size')) ELSE list_filter(['brand', 'size', 'type', 'weight'], lambda x: NOT (p_size > 25 AND x = 'size')) END) AS keys FROM part")
def wanted_keys(spark, sf_dir):
    lits = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    present = F.when(F.col("p_size") > 25, lits("size")).otherwise(lits())
    asked = F.when(F.col("p_partkey") % 2 == 0, lits("size", "weight")).otherwise(lits())
    return b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), k.wanted_keys(lits("weight", "type", "size", "brand"), present, asked).alias("keys"))


_FOLDED = lambda c: f"replace(strip_accents(lower(coalesce({c}, ''))), 'ß', 'ss')"


@query(
    f"""WITH w AS (SELECT item_id, {_FOLDED("text")} AS t FROM benchmark), terms AS (
        SELECT DISTINCT 'opening' AS kind, substr(t, 1, 12) AS term FROM w UNION SELECT 'word', regexp_extract(t, '[a-z]{{6,}}', 0) FROM w WHERE regexp_matches(t, '[a-z]{{6,}}'))
    SELECT DISTINCT doc_id AS message_id, kind, term FROM documents JOIN terms ON contains({_FOLDED("text")}, term)"""
)
def message_mentions(spark, sf_dir):
    """Documents that hold the opening, or the first word of six letters, of a benchmark item, inside words too."""
    from lodestone.functions.text import unmarked

    items = b.table(spark, sf_dir, "benchmark").select(unmarked(F.coalesce("text", F.lit(""))).alias("t"))
    word = F.regexp_extract("t", "[a-z]{6,}", 0)
    terms = items.select(F.lit("opening").alias("kind"), F.substring("t", 1, 12).alias("term")).unionByName(items.select(F.lit("word").alias("kind"), word.alias("term")))
    return k.mentions(b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("message_id"), "text"), terms.where("term <> ''").distinct())


_MENTION = "CASE l_linenumber % 3 WHEN 0 THEN concat(split_part(p_name, ' ', 1), ' ', lower(p_type)) WHEN 1 THEN upper(p_name) ELSE concat('el ', p_name, ' ', p_size) END"


@query(
    f"""WITH m AS (SELECT DISTINCT l_orderkey AS message_id, lower({_MENTION}) AS term FROM lineitem JOIN part ON p_partkey = l_partkey),
    names AS (SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_size > 45 UNION SELECT lower(p_brand) FROM part WHERE p_size > 45),
    t AS (SELECT DISTINCT term FROM m), matched AS (SELECT DISTINCT term FROM t JOIN names ON contains(name, term) OR contains(term, name))
    SELECT message_id, term FROM m WHERE term NOT IN (SELECT term FROM matched)"""
)
def unmatched_mentions(spark, sf_dir):
    """What orders name, in three wordings, against a catalogue of the parts over size 45: absent are terms that hold no name and stand in none."""
    part = b.table(spark, sf_dir, "part")
    lines = b.table(spark, sf_dir, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey"))
    said = lines.select(F.col("l_orderkey").alias("message_id"), F.expr(_MENTION).alias("term"))
    return k.unmatched(said, b.products(spark, sf_dir).where("size > 45"))


_CARD = "concat(p_brand, ' RTX ', CAST(4060 + 10 * (p_size % 3) AS STRING), CASE WHEN p_partkey % 2 = 0 THEN ' Ti' ELSE '' END, ' ', CAST(8 + p_size % 9 AS STRING), 'GB ', CAST(128 + 64 * (p_partkey % 3) AS STRING), '-bit')"


@query(f"WITH t AS (SELECT p_partkey AS id, {_CARD} AS s FROM part) SELECT id, upper(regexp_extract(s, '(RTX [0-9]+( Ti)?)', 1)) AS chipset, regexp_extract(s, '([0-9]+)GB', 1)::DOUBLE AS memory_gb, regexp_extract(s, '([0-9]+)-bit', 1)::INTEGER AS bus_bits FROM t")
def title_specs(spark, sf_dir):
    return b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), specs.title_specs(F.expr(_CARD)).alias("s")).select("id", "s.chipset", "s.memory_gb", "s.bus_bits")


@query(f"WITH t AS (SELECT p_partkey AS id, lower({_CARD}) AS s FROM part) SELECT id, regexp_extract(s, '([0-9]+)gb', 1)::DOUBLE AS value, 'gb' AS unit FROM t")
def name_hints(spark, sf_dir):
    found = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(specs.hints(F.expr(_CARD))).alias("h"))
    return found.select("id", "h.value", "h.unit")


@query("SELECT p_partkey AS id, p_partkey % 3 > 0 AS same FROM part")
def same_variant(spark, sf_dir):
    """Every third name is told of in its Pro variant."""
    other = F.concat_ws(" ", F.lit("new:"), F.upper("p_name"), F.when(F.col("p_partkey") % 3 == 0, "Pro").otherwise("2024"))
    return b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), specs.same_variant(F.col("p_name"), other).alias("same"))


@query(
    "SELECT id, CASE WHEN s = 'MATCH' AND NOT known THEN 'NO_MATCH' WHEN sure >= 0.95 THEN s WHEN sure >= 0.7 AND s = 'MATCH' THEN 'AMBIGUOUS' ELSE 'NO_MATCH' END AS status "
    "FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'AMBIGUOUS' ELSE 'MATCH' END AS s, c_custkey % 4 > 0 AS known, greatest(0, least(1, (c_custkey % 12) / 10::DOUBLE)) AS sure FROM customer)"
)
def confidence_policy(spark, sf_dir):
    answers = b.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "AMBIGUOUS").otherwise("MATCH").alias("status"), ((F.col("c_custkey") % 12) / 10.0).alias("confidence"),
        F.col("c_custkey").alias("product_id"), F.when(F.col("c_custkey") % 4 > 0, F.array("c_custkey")).otherwise(F.array(F.lit(-1).cast("bigint"))).alias("candidate_ids"),
    )
    return identity.confidence_policy(answers).select("id", "status")


_TAXONOMY = "SELECT * FROM (VALUES ('economy', false, 'P0'), ('small', true, 'P0'), ('promo', false, 'P9'), ('large', false, 'P1')) AS x(slug, is_group, priority)"


@query(f"WITH x AS ({_TAXONOMY}) SELECT p_partkey AS id, CASE WHEN slug IS NULL THEN 'unknown_category' WHEN is_group THEN 'is_group_node' WHEN slug = 'large' THEN 'blacklisted' WHEN priority = 'P9' THEN 'not_in_whitelist' END AS category_reason FROM part LEFT JOIN x ON slug = lower(p_type)")
def category_verdicts(spark, sf_dir):
    """Categories of parts, mapped by the store's name of them and judged by a taxonomy."""
    taxonomy = spark.sql(_TAXONOMY)
    rows = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit(" "), "p_type").alias("store_category"))
    mapped = ingest.mapped_categories(rows, taxonomy.select(F.upper("slug").alias("store_category"), F.col("slug").alias("category_slug")))
    return ingest.category_verdict(mapped, taxonomy, blacklist=("large",)).select("id", "category_reason")


_OLD = "SELECT lower(n_name) AS slug, n_name AS name, CAST(n_regionkey AS STRING) AS parent FROM {}"
_NEW = "SELECT lower(n_name) AS slug, concat(n_name, '!') AS name, CAST(n_regionkey + 1 AS STRING) AS parent FROM {} WHERE n_nationkey % 2 = 0 UNION ALL SELECT concat('new ', lower(r_name)), r_name, NULL FROM {}"


@query(f"WITH o AS ({_OLD.format('nation')} WHERE n_nationkey % 5 > 0), c AS ({_NEW.format('nation', 'region')}) SELECT slug, coalesce(c.name, o.name) AS name, CASE WHEN c.slug IS NOT NULL THEN c.parent ELSE o.parent END AS parent, CASE WHEN c.slug IS NULL THEN 'kept' WHEN o.slug IS NULL THEN 'created' ELSE 'updated' END AS change FROM o FULL JOIN c USING (slug)")
def seeded_tree(spark, sf_dir):
    nation, region = b.table(spark, sf_dir, "nation"), b.table(spark, sf_dir, "region")
    return admin.seeded(spark.sql(_OLD.format("{n}") + " WHERE n_nationkey % 5 > 0", n=nation), spark.sql(_NEW.format("{n}", "{r}"), n=nation, r=region))


@query("SELECT lower(n_name) AS slug FROM nation WHERE n_nationkey % 2 > 0 AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0)")
def obsolete_categories(spark, sf_dir):
    nation = b.table(spark, sf_dir, "nation")
    tree = spark.sql(_OLD.format("{n}"), n=nation)
    members = b.table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lower("n_name").alias("slug"))
    return admin.obsolete(tree, nation.where("n_nationkey % 2 = 0").select(F.lower("n_name").alias("slug")), members)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN c_name END AS label FROM customer")
def filled_blanks(spark, sf_dir):
    """Blank labels filled from a second reading; those that stand stay."""
    customer = b.table(spark, sf_dir, "customer")
    old = customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 5 == 0, "  ").alias("label"))
    new = customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))
    return admin.filled(old, new, "id", "label")


@query("SELECT s_suppkey AS offer_id, CASE WHEN n IS NOT NULL THEN 'error' ELSE 'success' END AS status, s_suppkey % 3 + coalesce(n, 0) AS failures FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1) ON l_suppkey = s_suppkey")
def offer_failures(spark, sf_dir):
    current = b.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("offer_id"), F.lit("success").alias("status"), (F.col("s_suppkey") % 3).alias("failures"))
    return admin.failures(current, b.table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("offer_id")))


_GROUND = "SELECT doc_id, 'k' || CAST(doc_id % 4 AS STRING) AS key, substr(coalesce(text, ''), 5, 12) AS value, CASE WHEN doc_id % 2 = 0 THEN 'zzz unheard' ELSE substr(coalesce(text, ''), 1, 30) END AS evidence, CASE WHEN doc_id % 3 = 0 THEN 'nothing here' ELSE coalesce(text, '') END AS context FROM {}"
_WORDS = lambda c: f"trim(regexp_replace({_FOLDED(c)}, '[^a-z0-9]+', ' ', 'g'))"


@query(f"WITH t AS ({_GROUND.format('documents')}) SELECT doc_id, key FROM t WHERE key IN ('k1', 'k2') AND length(value) <= 200 AND (({_WORDS('evidence')} <> '' AND contains({_WORDS('context')}, {_WORDS('evidence')})) OR ({_WORDS('value')} <> '' AND contains({_WORDS('context')}, {_WORDS('value')})))")
def grounded_values(spark, sf_dir):
    """Values that a model claims to have read, believed where the text holds them or their evidence."""
    rows = spark.sql(_GROUND.format("{d}"), d=b.table(spark, sf_dir, "documents"))
    return specs.grounded(rows, ["k1", "k2"]).select("doc_id", "key")


@query("WITH p AS (SELECT DISTINCT l_partkey AS product_id, l_returnflag AS definition, l_linestatus AS label, CAST(l_linenumber AS VARCHAR) AS value FROM lineitem WHERE l_linenumber < 3) SELECT product_id, definition, CASE WHEN count(*) = 1 THEN any_value(value) ELSE string_agg(label || ': ' || value, '; ' ORDER BY label, value) END AS value FROM p GROUP BY ALL")
def collected_values(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").where("l_linenumber < 3").select(F.col("l_partkey").alias("product_id"), F.col("l_returnflag").alias("definition"), F.col("l_linestatus").alias("label"), F.col("l_linenumber").cast("string").alias("value"))
    return specs.collected(rows)


@query("SELECT s_nationkey AS product_id, coalesce(arg_min(url, (p, place, url)) FILTER (WHERE manu), arg_min(url, (place, url))) AS url FROM (SELECT s_nationkey, s_suppkey % 3 = 0 AS manu, s_suppkey % 4 AS p, s_suppkey % 5 AS place, s_name AS url FROM supplier) GROUP BY 1")
def preferred_sources(spark, sf_dir):
    rows = b.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("product_id"), F.when(F.col("s_suppkey") % 3 == 0, "manufacturer").otherwise("web").alias("kind"), (F.col("s_suppkey") % 4).alias("priority"), (F.col("s_suppkey") % 5).alias("place"), F.col("s_name").alias("url"))
    return specs.lowest_manufacturer_source(rows)


@query("SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'tool_error' WHEN turn % 3 = 0 AND length(text) % 2 = 0 THEN 'no_results' WHEN turn % 3 = 0 AND length(text) > 500 THEN 'over_budget' WHEN turn % 3 = 1 AND length(text) % 2 > 0 AND length(text) % 3 = 0 THEN 'no_stock' WHEN turn % 3 = 2 AND length(text) % 5 = 0 THEN 'high_price' END AS diagnosis FROM conversations")
def tool_diagnosis(spark, sf_dir):
    turn, n = F.col("turn"), F.length("text")
    tool = F.element_at(F.array(*map(F.lit, ("search_products", "get_product_offers", "analyze_price_trend"))), (turn % 3 + 1).cast("int"))
    said = research.diagnosis(tool, turn % 4 == 0, n % 2, n, n % 3, F.when(n % 5 == 0, "esperar").otherwise("comprar"), F.lit(500))
    return b.table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("diagnosis"))


_MARKS = {name: marks for name, marks, _, _ in research.TOPICS}
_LOW = "lower(coalesce(text, ''))"
_N_TOPICS = " + ".join("(CASE WHEN " + " OR ".join(f"contains({_LOW}, '{w}')" for w in marks) + " THEN 1 ELSE 0 END)" for marks in _MARKS.values())


@query(f"SELECT conv_id, turn, CASE WHEN NOT (role = 'user' AND turn % 5 < 4) THEN 'none' WHEN " + " OR ".join(f"contains({_LOW}, '{w}')" for w in ("investiga", "a fondo", "en detalle", "profundidad")) + f" OR {_N_TOPICS} >= 2 OR turn % 4 = 2 THEN 'deep' WHEN conv_id % 2 = 0 THEN 'light' ELSE 'catalog' END AS depth FROM conversations")
def research_depth(spark, sf_dir):
    found = research.depth(F.col("text"), F.col("role") == "user", F.col("turn") % 5 < 4, F.col("turn") % 4 == 2, F.col("conv_id") % 2 == 0)
    return b.table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("depth"))


_SHOP = (
    "concat('<html><head><title>', p_name, '</title>', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('<script type=\"application/ld+json\">{\"@type\": \"Product\", \"name\": \"', p_name, ' ld\", \"brand\": {\"name\": \"', p_brand, '\"}, \"sku\": \"S', CAST(p_partkey AS STRING), "
    "'\", \"offers\": [{\"price\": \"', CAST(p_size + 5 AS STRING), '\", \"priceCurrency\": \"CLP\", \"availability\": \"https://schema.org/OutOfStock\"}, {\"price\": \"', CAST(p_size + 9 AS STRING), '\", \"priceCurrency\": \"CLP\", \"availability\": \"https://schema.org/InStock\"}]}</script>') END, "
    "'<meta property=\"og:title\" content=\"', p_name, ' og\"><meta property=\"product:price:amount\" content=\"', CAST(p_size AS STRING), '\"></head><body>', CASE WHEN p_partkey % 4 = 0 THEN concat('<script id=\"__NEXT_DATA__\" type=\"application/json\">{\"id\": ', CAST(p_partkey AS STRING), '}</script>') ELSE '' END, '</body></html>')"
)


def _shop(spark, sf_dir):
    return b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(_SHOP).alias("html"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' og' ELSE p_name || ' ld' END AS name, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 3 > 0 THEN 'S' || p_partkey END AS sku, (CASE WHEN p_partkey % 3 > 0 THEN p_size + 9 ELSE p_size END)::DOUBLE AS price, CASE WHEN p_partkey % 3 > 0 THEN 'CLP' END AS currency FROM part")
def page_products(spark, sf_dir):
    """Shop pages of all parts, two of three with JSON-LD, of whose two offers the one in stock counts."""
    from lodestone.sources import pages

    return pages.products(_shop(spark, sf_dir)).select("id", "name", "brand", "sku", "price", "currency")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_partkey END AS state_id FROM part")
def page_state(spark, sf_dir):
    from lodestone.sources.pages import embedded_state

    return _shop(spark, sf_dir).select("id", F.try_variant_get(embedded_state(F.col("html")), "$.id", "bigint").alias("state_id"))


@query("SELECT page_id, url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'https://a.example.com/map' || page_id || '.xml' FROM pages")
def sitemap_locations(spark, sf_dir):
    from lodestone.functions.urls import sitemap_locations as locations

    amp = lambda c: F.replace(c, F.lit("&"), F.lit("&amp;"))
    own = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<url><loc>"), amp(F.col("url")), F.lit("</loc></url>"))).otherwise("")
    xml = F.concat(F.lit("<urlset>"), own, F.lit("<url><loc> https://a.example.com/map"), "page_id", F.lit(".xml </loc></url></urlset>"))
    return b.table(spark, sf_dir, "pages").select("page_id", F.explode(locations(xml)).alias("url"))
