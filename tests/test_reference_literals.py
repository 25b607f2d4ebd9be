"""Small cases with known results for the catalogue, price, identity and text operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.functions import urls as u
from lodestone.operators import catalog, dialog, evidence, identity, ingest, prices, quality, retrieval


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x")).alias("r")).first()["r"]


@pytest.fixture(scope="module")
def notebooks(spark):
    products = spark.createDataFrame([(1, "Notebook Gama Alta", "Lenovo", "Notebooks"), (2, "Notebook Gama Media", "Lenovo", "Notebooks"), (3, "Notebook Económico", "HP", "Notebooks"), (4, "Notebook Pro", "Apple", "Notebooks")], "id long, name string, brand string, category string")
    offers = spark.createDataFrame([(1, 1, 800000), (2, 1, 550000), (3, 1, 320000), (4, 1, 1500000)], "product_id long, store_id long, price long")
    specs = spark.createDataFrame([(1, "ram", 16.0, None), (2, "ram", 8.0, None), (3, "ram", 8.0, None), (4, "ram", 32.0, None), (1, "screen", None, "2560 × 1440"), (2, "screen", None, "1920 × 1080"), (3, "screen", None, "1366 × 768")], "product_id long, key string, value_number double, value_text string")
    return products, offers, specs


def test_search(notebooks):
    products, offers, specs = notebooks
    find = lambda **k: catalog.search(products, offers, spec_values=specs, **k)
    assert find(ranges={"ram": "16-32"}).count() == 2
    assert find(ranges={"ram": "32-16"}).count() == 4
    assert find(options={"screen": ["1920 × 1080"]}).count() == 1
    assert find(options={"screen": ["1920 × 1080", "1366 × 768"]}).count() == 2
    assert [find(brand=b).count() for b in ("Lenovo", "Lenovo,Apple", "Lenovo,HP,apple")] == [2, 3, 4]
    assert catalog.paged(find(), order="price_asc").first()["id"] == 3
    assert catalog.paged(find(), order="price_desc").first()["id"] == 4
    assert find(ids="x").count() == 0
    assert find(query="notebooks para").count() == 4
    s = catalog.facet_summary(products, offers).first()
    assert (s["total"], s["min_price"], s["max_price"]) == (4, 320000, 1500000)


def test_tree(spark):
    tree = spark.createDataFrame([(1, None, "Tecnología", 0), (2, 1, "Computadores", 0), (3, 2, "Notebooks", 0), (4, 1, "PC", 1)], "id long, parent_id long, name string, sort_order int")
    counts = {r["name"]: (r["products"], r["total_products"]) for r in catalog.tree_counts(tree, spark.createDataFrame([(3,)] * 4, "category_id long")).collect()}
    assert counts == {"Tecnología": (0, 4), "Computadores": (0, 4), "Notebooks": (4, 4), "PC": (0, 0)}
    assert {r["id"] for r in catalog.subtree(tree, 2).collect()} == {2, 3}
    assert [catalog.category_named(tree, x).first()["id"] for x in ("notebooks", "laptop")] == [3, 2]


def test_synonyms():
    assert len(t.search_terms("Busca un notebook para gaming")) == 2
    assert "smartphone" in t.synonyms("Celulares") and "laptop" in t.synonyms("notebook")
    assert t.synonyms("télefono") >= {"telefono", "celular"}


@pytest.mark.parametrize(("history", "current", "verdict"), [((100, 110, 120, 105), 100, "buen_momento"), ((100, 100, 100, 100), 120, "esperar"), ((100, 100, 100, 100), 102, "buen_momento"), ((90, 110, 100, 100), 101, "precio_normal"), ((100, 100), 100, "sin_historial_suficiente"), ((100, 100, 100), None, "sin_precio_actual")])
def test_trend(spark, history, current, verdict):
    seen = spark.createDataFrame([(1, p) for p in history], "product_id long, price long")
    now = spark.createDataFrame([(1, current)] if current else [], "product_id long, price long")
    assert prices.trends(seen, now).first()["verdict"] == verdict


def test_identity_keys(spark):
    assert one(spark, t.gtin, "0-12345 678905") == "012345678905"
    assert one(spark, t.gtin, "12345") is None
    assert one(spark, t.brand_key, " Électro ") == "electro"
    assert set(one(spark, t.mpn_forms, " rtx-5070 ")) == {"RTX-5070", "RTX5070", "RTX 5070"}
    assert one(spark, t.slug, "Año 2024 -- Pro!") == "a-o-2024-pro"


def test_match(spark):
    schema = "gtin string, brand string, mpn string, model string, sku string, name string"
    products = spark.createDataFrame([(1, "12345678", "Acer", "A-1", "One", "AB1", "Acer One"), (2, None, "Acer", "A 2", "Two", "AB2", "Acer Two"), (3, None, "Acer", "A2", "Three", "77", "Acer Three")], "product_id long, " + schema)
    offers = spark.createDataFrame([(1, "12345678", "acer", "A2", None, None, "x", False), (2, None, "ACER", "A/2", None, None, "x", False), (3, None, "acer", None, "one", "AB2", "x", False), (4, None, "acer", None, None, "77", "x", False), (5, None, "acer", None, " ONE", None, "x", False)], "offer_id long, " + schema + ", sku_is_identity boolean")
    products = products.withColumn("sku_is_identity", F.lit(False))
    found = {r["offer_id"]: (r["status"], r["strategy"], r["product_id"]) for r in identity.match(offers, products).collect()}
    assert found == {1: ("MATCH", "gtin", 1), 2: ("AMBIGUOUS", "mpn_brand", None), 3: ("MATCH", "manufacturer_sku", 2), 4: ("NO_MATCH", None, None), 5: ("NO_MATCH", None, None)}
    assert [tuple(r) for r in identity.conflicts(offers, products).collect()] == [(1, 1, 2)]
    from difflib import SequenceMatcher

    close = identity.candidates(offers.withColumn("name", F.lit("acer ones")), products).collect()
    assert close and all(abs(r["score"] - SequenceMatcher(None, "acer ones", {1: "acer one", 2: "acer two", 3: "acer three"}[r["product_id"]]).ratio()) < 1e-6 for r in close)


def test_confidence_policy(spark):
    rows = [("MATCH", 0.97, 1, [1, 2]), ("MATCH", 0.8, 1, [1]), ("MATCH", 0.5, 1, [1]), ("MATCH", 0.99, 9, [1]), ("MATCH", 1.7, 1, [1])]
    out = identity.confidence_policy(spark.createDataFrame(rows, "status string, confidence double, product_id long, candidate_ids array<long>")).collect()
    assert [r["status"] for r in out] == ["MATCH", "AMBIGUOUS", "NO_MATCH", "NO_MATCH", "MATCH"]


def test_words(spark):
    assert [one(spark, t.condition, x) for x in ("Open-Box", "reacondicionado", "semi nuevo", "usado", "https://schema.org/NewCondition", None)] == ["open_box", "refurbished", "semi_new", "used", "new", "unknown"]
    assert [one(spark, t.stock, x) for x in ("Unavailable", "https://schema.org/InStock", "x")] == ["out_of_stock", "in_stock", "unknown"]
    assert [one(spark, t.peso_amount, x) for x in ("500 lucas", "$500.000", "12", "300 mil")] == [500000, 500000, None, 300000]
    assert [tuple(r) for r in one(spark, t.numbers_with_units, "16 GB, 2,5 kg y 50 Wh")] == [(16.0, "gb"), (2.5, "kg"), (50.0, "wh")]


def test_urls(spark):
    f = u.normal_url
    assert one(spark, f, "http://Shop.Example:80/a/b/?utm_source=x&page=2#top") == "https://shop.example/a/b?page=2"
    assert one(spark, f, "https://shop.example:8080") == "https://shop.example:8080/"
    page = '<html><head><title> A </title><meta property="og:title" content="P1"><meta name="og:title" content="N"><meta name="author" content="X"><meta property="og:title" content="P2"><script type="application/ld+json">[{"@type":"Product","name":"n"}]</script><script type="application/ld+json">{bad</script></head><body>1 &lt; 2<br>b</body></html>'
    assert one(spark, u.meta_tags, page) == {"og:title": "P2", "author": "X"}
    assert one(spark, u.page_title, page) == "A"
    assert one(spark, lambda c: F.size(u.json_ld_blocks(c)), page) == 1
    assert one(spark, u.page_text, page) == "A 1 < 2 b"
    assert one(spark, u.sitemap_locations, "<loc>a</loc><loc> b </loc>") == ["a", "b"]


def test_dialog(spark):
    assert [one(spark, dialog.intent, x) for x in ("¿Es compatible?", "compara estos", "cuánto cuesta", "busco un mouse", "hola")] == ["compatibility", "compare", "price_check", "search", "general_question"]
    refs = lambda x: one(spark, lambda c: dialog.references(c, 3), x)
    assert [refs(x) for x in ("el segundo", "los dos", "todos", "ese tiene", "la quinta", None)] == [[1], [0, 1], [0, 1, 2], [0], [], []]
    assert [one(spark, dialog.budget, x) for x in ("tengo 5 y hasta 300 lucas", "2 palos, maximo 1,5 millones", "nada", None)] == [300000, 1500000, None, None]
    assert one(spark, dialog.preferences, "Prefiero marcas nuevas. ¿Odio? Me encanta el rojo; ok") == ["Prefiero marcas nuevas"]
    assert one(spark, dialog.preferences, "Prefiero marcas nuevas.\nMi presupuesto típico es bajo; prefierolo. Compro solo en tiendas!") == ["Prefiero marcas nuevas", "Mi presupuesto típico es bajo", "Compro solo en tiendas"]
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(8)], "conv_id long, turn long, role string, text string")
    assert sorted(r["turn"] for r in dialog.window(turns, 3).collect()) == [4, 5, 6, 7]
    assert [r["query"] for r in dialog.rewritten(turns).orderBy("turn").collect()] == ["0", "0 2", "2 4", "4 6"]


def test_chunks(spark):
    text = "abc. " * 400
    parts = one(spark, lambda c: retrieval.chunks(c, F.lit(900), F.lit(120)), text)
    assert all(len(p) <= 900 for p in parts) and parts[0].endswith(".") and "".join(parts).count("abc") >= 400
    assert one(spark, lambda c: retrieval.chunks(c, F.lit(900), F.lit(120)), " x ") == ["x"]
    assert one(spark, lambda c: retrieval.chunks(c, F.lit(900), F.lit(120)), None) == []


def fold_of(spark, rows):
    """(value, source, status, forced[, name]) in order -> (action, value, source, status, conflict)."""
    full = [(1, "ram", i, v, s, st, f, *(more or [None])) for i, (v, s, st, f, *more) in enumerate(rows)]
    df = spark.createDataFrame(full, "product_id long, definition_id string, seq long, value string, source string, status string, forced boolean, source_name string")
    return [(r["seq"], r["action"], r["value"], r["status"], r["conflict"]) for r in quality.upsert_fold(df).orderBy("seq").collect()]


def test_spec_fold(spark):
    rows = [("8", "scraper", "auto", False), ("8", "scraper", "auto", False), ("16", "manufacturer", "auto", False), ("8", "scraper", "auto", False), ("16", "admin", "verified", False), ("32", "manufacturer", "auto", False)]
    assert fold_of(spark, rows) == [(0, "created", "8", "auto", "none"), (2, "value_changed", "16", "review", "pending"), (3, "conflict_detected", "16", "review", "pending"), (4, "source_updated", "16", "verified", "resolved"), (5, "conflict_detected", "16", "verified", "pending")]


def test_spec_fold_keeps_what_is_verified(spark):
    """The same value from a lesser source leaves a verified one as it is; a forced one does not; another one is a conflict, but an administrator's changes it."""
    start = ("a", "scraper", "verified", False)
    assert fold_of(spark, [start, ("a", "manufacturer", "auto", False), ("b", "manufacturer", "auto", False)]) == [(0, "created", "a", "verified", "resolved"), (2, "conflict_detected", "a", "verified", "pending")]
    assert fold_of(spark, [start, ("a", "ai", "auto", True)])[1] == (1, "source_updated", "a", "auto", "none")
    assert fold_of(spark, [start, ("b", "store", "verified", False)])[1][1:3] == ("conflict_detected", "a")
    assert fold_of(spark, [start, ("b", "admin", "auto", False)])[1] == (1, "value_changed", "b", "review", "pending")


def test_spec_fold_statuses_and_sources(spark):
    """A repeat after a change returns the state to auto; another name of the same kind of source is another source."""
    rows = [("8", "ai", "auto", False), ("16", "manufacturer", "auto", False), ("16", "manufacturer", "auto", False)]
    assert fold_of(spark, rows)[1:] == [(1, "value_changed", "16", "review", "pending"), (2, "source_updated", "16", "auto", "pending")]
    assert [x[1] for x in fold_of(spark, [("8", "store", "auto", False, "a"), ("8", "store", "auto", False, "b"), ("8", "store", "auto", False, "b"), ("8", "ai", "auto", False, "b")])] == ["created", "source_updated"]
    kinds = spark.range(1).select(
        quality.snapshot(number=F.lit(16), unit=F.lit("GB")) == quality.snapshot(number=F.lit(16.0), unit=F.lit("GB")),
        quality.snapshot(number=F.lit(16)) == quality.snapshot(text=F.lit("16")),
        quality.snapshot(json=F.lit('{"b": 1, "a": [2]}')) == quality.snapshot(json=F.lit('{"a":[2],"b":1}')),
        quality.snapshot(boolean=F.lit(True)),
    )
    assert tuple(kinds.first()) == (True, False, True, '{"boolean":true}')


def test_evidence(spark):
    rows = [("a", "270"), ("a", "270"), ("b", "1"), ("b", "2"), ("b", "2"), ("c", None)]
    out = {r["claim"]: (r["verdict"], r["supporters"], r["conflicting_pairs"]) for r in evidence.verdicts(spark.createDataFrame(rows, "claim string, value string")).collect()}
    assert out["a"] == ("agreement", 2, 0) and out["b"] == ("conflict", 2, 2) and out["c"][0] == "insufficient"


def test_validation(spark):
    rows = [("s", "n", "https://x", 10.0, "CLP", "new"), (" ", "n", "https://x", 10.0, "CLP", "new"), ("s", "n", "ftp://x", 10.0, "CLP", "new"), ("s", "n", "https://x", 0.0, "CLP", "new"), ("s", "n", "https://x", 10.5, "CLP", "new"), ("s", "n", "https://x", 10.0, "PESO", "new"), ("s", "n", "https://x", 10.0, None, None)]
    out = [r[0] for r in spark.createDataFrame(rows, "source string, name string, product_url string, price double, currency string, condition string").select(ingest.reject_reason()).collect()]
    assert out == [None, "source_or_name_missing", "url_not_http", "price_not_positive", "price_has_fraction", "currency_not_iso", "currency_not_iso"]


def test_alerts_and_merge(spark):
    seen = spark.createDataFrame([(1, 1, 90, True, datetime(2024, 1, 2)), (1, 1, 100, True, datetime(2024, 1, 1))], "product_id long, store_id long, price long, available boolean, observed_at timestamp_ntz")
    targets = spark.createDataFrame([(7, 1, 95), (8, 1, 10)], "alert_id long, product_id long, target long")
    assert {r["alert_id"]: r["fired_at"] for r in prices.alerts(targets, seen).collect()} == {7: datetime(2024, 1, 2), 8: None}
    batch = seen.withColumns({"order_id": F.lit(1), "line_no": F.lit(1)})
    current = seen.where("price = 100")
    assert [tuple(r) for r in ingest.merge_offers(current, batch).select("price", "change").collect()] == [(90, "price_changed")]
    again = ingest.merge_offers(ingest.merge_offers(current, batch).drop("change"), batch).first()
    assert (again["price"], again["change"]) == (90, "updated")
