"""Cases for specification reading, research, memories, upkeep, page sources and sinks."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import urls as u
from lodestone.operators import admin, memory, research, specs
from lodestone.sources import pages, sinks


def one(spark, col, *values):
    return spark.createDataFrame([values], ", ".join(f"x{i} string" for i in range(len(values)))).select(col(*[F.col(f"x{i}") for i in range(len(values))]).alias("r")).first()["r"]


def test_reading(spark):
    gb = lambda x: one(spark, lambda c: specs.number_in(c, "GB"), x)
    assert [gb(x) for x in ("8 GB", "2TB", "1,5 gigabytes", "8G")] == [8.0, 2048.0, 1.5, None]
    assert [one(spark, specs.yes_no, x) for x in ("Sí", "no incluye", "quizás")] == [True, False, None]
    assert [one(spark, specs.resolution, x) for x in ("2560 x 1440", "Full HD", "FHD", "QHD", "x")] == ["2560 × 1440", "1920 × 1080", "1920 × 1080", "1366 × 768", None]
    assert one(spark, specs.memory_type, "16 GB LPDDR5X-7500") == "LPDDR5X"
    ports = [tuple(p) for p in one(spark, specs.usb_ports, "2 x USB 3.2 Gen 2 Type-C; 4x USB 2.0, HDMI")]
    assert ports == [("USB", "3.2 Gen 2", "Type-C", 2), ("USB", "2.0", None, 4), ("HDMI", None, None, None)]
    assert tuple(one(spark, specs.title_specs, "ASUS RTX 5070 Ti 16GB 256-bit")) == ("RTX 5070 TI", 16.0, 256)
    assert [tuple(h) for h in one(spark, specs.hints, "Laptop 1TB 50 Wh")] == [(1024.0, "gb"), (50.0, "w")]
    assert [one(spark, specs.same_variant, *x) for x in (("POCO X6", "Poco X6 5G global"), ("POCO X6", "Poco X6 Pro"), ("iPhone 15 Pro", "iphone 15"))] == [True, False, False]


def test_resolution_of_values(spark):
    rows = [(1, "ram", "8", 1, False, False), (1, "ram", "16", 2, False, True), (2, "ram", "8", 1, False, False), (2, "ram", "16", 2, False, False), (3, "color", "a", 2, True, False), (3, "color", "b", 1, True, False)]
    out = {r["product_id"]: (r["value"], r["ambiguous"]) for r in specs.resolved(spark.createDataFrame(rows, "product_id long, key string, value string, place int, multi boolean, hinted boolean")).collect()}
    assert out == {1: ("16", False), 2: (None, True), 3: ("b", False)}
    found = spark.createDataFrame([("ram", "16 GB", "memoria de 16 GB", "Tiene memoria de 16  gb."), ("x", "16", "16", "16"), ("ram", "32", "", "16 gb")], "key string, value string, evidence string, context string")
    assert specs.grounded(found, ["ram"]).count() == 1
    items = spark.createDataFrame([(1, "d", "A", "1"), (1, "d", "B", "2"), (2, "d", "A", "1")], "product_id long, definition string, label string, value string")
    assert {r["product_id"]: r["value"] for r in specs.collected(items).collect()} == {1: "A: 1; B: 2", 2: "1"}


def test_research(spark):
    assert one(spark, research.topics, "¿Qué rendimiento y precio tiene?") == ["benchmarks", "precio"]
    score = lambda *x: one(spark, lambda t, s, l, b, m: research.result_score(t, s, l, b, m, F.lit(False)), *x)
    assert score("ASUS RTX 5070", "specs", "https://www.asus.com/x", "asus", "RTX 5070") == pytest.approx(0.6 + 0.35 + 0.2)
    assert score("other", "thing", "https://x.example", "asus", "RTX 5070") == 0.0
    assert [tuple(x) for x in one(spark, research.benchmark_scores, "Geekbench 6 Single-Core: 2345 and multi core 9876")] == [("6", "single", 2345), (None, "multi", 9876)]
    rows = spark.createDataFrame([(t, t * 10 + i, 1.0 - i / 10) for t in range(3) for i in range(4)], "target_id long, result_id long, score double")
    assert sorted(r["result_id"] for r in research.selected(rows, 3, 6).collect()) == [0, 1, 10, 11, 20, 21]


def test_memories(spark):
    rows = [(1, "preference", 1, "Quiero  rojo", [1.0, 0.0], 2), (1, "fact", 2, "quiero rojo", [0.0, 1.0], 5), (1, "preference", 3, "otra", [0.99, 0.05], 3), (1, "fact", 4, "otra cosa", [0.99, 0.05], 1), (2, "fact", 5, "otra cosa", [1.0, 0.0], 1)]
    out = {r["seq"]: (r["kept_seq"], r["created"], r["importance"]) for r in memory.added(spark.createDataFrame(rows, "user_id long, kind string, seq long, content string, vector array<double>, importance int")).collect()}
    assert out == {1: (1, True, 2), 2: (1, False, 5), 3: (1, False, 5), 4: (4, True, 1), 5: (5, True, 1)}


def test_upkeep(spark):
    tree = spark.createDataFrame([("a", "A", None), ("b", "B", "a"), ("old", "Old", "a"), ("used", "U", "a")], "slug string, name string, parent string")
    canonical = spark.createDataFrame([("a", "AA", None), ("b", "B", "a"), ("c", "C", "b")], "slug string, name string, parent string")
    assert {r["slug"]: (r["name"], r["change"]) for r in admin.seeded(tree, canonical).collect()} == {"a": ("AA", "updated"), "b": ("B", "updated"), "c": ("C", "created"), "old": ("Old", "kept"), "used": ("U", "kept")}
    assert [r["slug"] for r in admin.obsolete(tree, canonical, spark.createDataFrame([("used",)], "slug string")).collect()] == ["old"]
    rows = spark.createDataFrame([(1, "x"), (2, "")], "id long, t string")
    with pytest.raises(ValueError):
        admin.guarded_delete(rows, spark.createDataFrame([(9,)], "id long"), "id", 1)
    assert admin.guarded_delete(rows, rows.where("id = 1"), "id", 1).count() == 1
    assert {r["id"]: r["t"] for r in admin.filled(rows, spark.createDataFrame([(1, "n"), (2, "n")], "id long, t string"), "id", "t").collect()} == {1: "x", 2: "n"}


PAGE = '<html><head><title>T</title><meta property="og:title" content="Meta"><meta property="product:price:amount" content="9"><script type="application/ld+json">{"@type":["Product"],"name":"N","brand":{"name":"B"},"sku":"S","offers":[{"price":"20","priceCurrency":"CLP","availability":"https://schema.org/InStock"},{"price":"10","availability":"OutOfStock"}]}</script><script id="__NEXT_DATA__" type="application/json">{"a":1}</script></head></html>'


def test_product_pages(spark):
    bare = PAGE.replace("application/ld+json", "text/plain")
    none = '<script type="application/ld+json">{"@type":"Product","name":"N","offers":[]}</script>'
    out = pages.products(spark.createDataFrame([(1, PAGE), (2, bare), (3, none), (4, "")], "id long, html string")).orderBy("id").collect()
    assert [(r["name"], r["brand"], r["price"], r["currency"]) for r in out] == [("N", "B", 20.0, "CLP"), ("Meta", None, 9.0, None), ("N", None, None, None), (None, None, None, None)]
    assert one(spark, lambda c: F.try_variant_get(pages.embedded_state(c), "$.a", "int"), PAGE) == 1
    assert one(spark, lambda c: u.platform(c, u.meta_tags(c)), PAGE)["name"] == "Next.js"
    assert one(spark, lambda c: u.platform(c, u.meta_tags(c)), "<p>") is None
    assert [one(spark, u.safe_to_fetch, x) for x in ("https://a.example/x", "ftp://a.example", "http://127.0.0.1/", "http://10.0.0.1", "https://db.internal/", None)] == [True, False, False, False, False, False]


def test_sitemaps(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc>https://a.example/x?utm_source=1</loc></url><url><loc>https://a.example/x/</loc></url><loc>https://a.example/blog/y</loc></urlset>")
    found = pages.sitemaps(spark, str(tmp_path), exclude=("/blog/",))
    assert [(r["normal"], r["n"]) for r in pages.discovered(found).collect()] == [("https://a.example/x", 2)]


def test_sinks(spark, tmp_path):
    s = sinks.Snapshots(spark, str(tmp_path / "t"))
    s.write(spark.range(3))
    s.write(spark.range(5))
    assert s.read().count() == 5
    df, seen = sinks.observed(spark.createDataFrame([(None, "created"), ("x", None), (None, "price_changed")], "reject_reason string, change string"), "run")
    df.write.parquet(str(tmp_path / "out"))
    sinks.record_run(spark, str(tmp_path / "runs"), "s", seen.get)
    assert tuple(spark.read.parquet(str(tmp_path / "runs")).first()) == ("s", 3, 1, 1, 1, "partial")
    sinks.append(spark.range(2).withColumn("d", F.lit(1)), str(tmp_path / "h"), "d")
    assert sinks.as_json(spark.range(1)).first()["value"] == '{"id":0}'


def test_payloads(spark):
    from lodestone.functions import payloads

    assert one(spark, payloads.first_object, 'Sure: {"a": "}{", "b": {"c": 1}} bye') == '{"a": "}{", "b": {"c": 1}}'
    assert [one(spark, payloads.first_object, x) for x in ("{open", "none", None)] == [None, None, None]
    chunk = r'<script>self.__next_f.push([1,"x:{\"a\":{\"@type\":\"Product\",\"name\":\"N \\\"q\\\"\",\"offers\":{\"price\":1}}}"])</script>'
    assert one(spark, payloads.streamed_product, chunk) == '{"@type": "Product", "name": "N \\"q\\"", "offers": {"price": 1}}'
    assert one(spark, payloads.streamed_product, "<p>") is None


def test_categories_and_depth(spark):
    from lodestone.operators import ingest

    tax = spark.createDataFrame([("cpu", False, "P0"), ("all", True, "P0"), ("toys", False, "P9")], "slug string, is_group boolean, priority string")
    mapped = ingest.mapped_categories(spark.createDataFrame([(1, " CPUs "), (2, "All"), (3, "Toys"), (4, "?")], "id long, store_category string"), spark.createDataFrame([("cpus", "cpu"), ("all", "all"), ("toys", "toys")], "store_category string, category_slug string"))
    assert {r["id"]: r["category_reason"] for r in ingest.category_verdict(mapped, tax).collect()} == {1: None, 2: "is_group_node", 3: "not_in_whitelist", 4: "unknown_category"}
    assert [one(spark, ingest.url_eligibility, x) for x in ("https://a.example/notebook-1", "https://a.example/pack-2", "ftp://x", None)] == [None, "is_bundle", "missing_url", "missing_url"]
    t, f = F.lit(True), F.lit(False)
    assert [one(spark, lambda c: research.depth(c, t, p, g, w), m) for m, p, g, w in (("investiga esto", t, f, f), ("precio y rendimiento", t, f, f), ("hola", t, f, t), ("hola", t, f, f), ("hola", f, t, t))] == ["deep", "deep", "light", "catalog", "none"]


def test_sheets(spark):
    from lodestone.operators import sheets

    products = spark.createDataFrame([(1, "Acer", None), (2, "", "CPU")], "id long, brand string, category string")
    values = spark.createDataFrame([(1, "B", 2, "y", "2"), (1, "B", 1, "z", "1"), (1, "A", 1, "z", "3"), (1, "C", 1, "w", "")], "product_id long, `group` string, sort_order int, label string, value string")
    out = {r["id"]: r for r in sheets.sheets(products, values).collect()}
    assert [g["label"] for g in out[1]["general"]] == ["Marca"] and [(s["group"], [i["label"] for i in s["items"]]) for s in out[1]["groups"]] == [("A", ["z"]), ("B", ["z", "y"])] and out[2]["groups"] == []
    flat = sheets.sheets(products, values).where("id = 1").select(sheets.flattened(F.col("groups")).alias("m")).first()["m"]
    assert flat == {"z": "1", "y": "2"}
    n = F.lit(None)
    show = lambda number, unit: spark.range(1).select(sheets.shown(n.cast("boolean"), F.lit(number), n.cast("string"), n.cast("array<string>"), F.lit(unit), n.cast("string"))).first()[0]
    assert [show(2.0, "GB"), show(2.5, '"'), show(3.0, None)] == ["2 GB", '2.5"', "3"]
