"""Substring matching, joins of similar names, the closure of a tree, folding and numeric hosts, against brute force."""

import random
import string
import unicodedata
from difflib import SequenceMatcher

import pytest

from pyspark.sql import functions as F

from lodestone.functions import text, urls
from lodestone.operators import catalog, identity, knowledge, names, specs, substrings


@pytest.mark.parametrize("bounds", [{}, {"most_terms": 3}, {"most_characters": 1}])
def test_substrings_both_ways(spark, bounds):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    texts = [(i, word(rng.randrange(0, 60))) for i in range(200)] + [(900, None), (901, ""), (902, "aaaa"), (902, "aaaa"), (903, "abc" * 4000 + "needle")]
    terms = {word(rng.randrange(1, 8)) for _ in range(60)} | {"aaaaa", "a", "needle", "a.c", "%"}
    df = spark.createDataFrame(texts, "id long, text string").withColumn("term", F.lit("clash"))
    found = substrings.held(df, spark.createDataFrame([(t,) for t in [*terms, "a", "", None]], "term string"), **bounds)
    want = sorted((i, t, w) for i, t in texts if t for w in terms if w and w in t)
    assert sorted((r["id"], r["text"], r["term"]) for r in found.collect()) == want
    none = spark.createDataFrame([], "term string")
    assert substrings.held(df, none, **bounds).count() == 0 and substrings.held(df.limit(0), found.select("term"), **bounds).count() == 0


@pytest.mark.parametrize("bounds", [{}, {"most_terms": 1}])
def test_long_texts_stay_behind(spark, bounds):
    """Pairs come without their text, and 700 texts in pieces of the batch; mentions leave the text behind as well."""
    texts = spark.range(700).select("id", F.concat(F.lit("ab needle "), F.col("id"), F.repeat(F.lit(" tail"), 200)).alias("text"))
    terms = spark.createDataFrame([("ab",), ("needle 69",), ("zz",)], "term string")
    found = substrings.held(texts, terms, keep=["id"], **bounds)
    assert found.columns == ["id", "term"] and sorted(map(tuple, found.collect())) == sorted([(i, "ab") for i in range(700)] + [(i, "needle 69") for i in range(700) if str(i).startswith("69")])
    named = knowledge.mentions(texts.withColumnRenamed("id", "message_id"), terms.withColumn("kind", F.lit("k")))
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert len(made) == 1 and "said" not in made[0].split("[")[1] and named.count() == 711


def test_large_dictionaries_make_no_nested_loop(spark):
    texts = spark.range(50).select(F.col("id"), F.concat(F.lit("text number "), "id").alias("text"))
    found = substrings.held(texts, spark.range(50).select(F.concat(F.lit("number "), "id").alias("term")), most_terms=10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and found.count() == 10 + 40 * 2


def test_absent_mentions(spark):
    known = spark.createDataFrame([("iPhone 15 128GB Negro", "Apple"), ("Poco M8", "Xiaomi"), (None, None), ("", "")], "name string, brand string")
    said = [(1, "iphone 15"), (1, "Galaxy S24"), (2, "el xiaomi 14"), (2, "galaxy s24 "), (3, "s2"), (3, None), (4, "Galaxy S24"), (4, "galaxy s24")]
    mentions = spark.createDataFrame(said, "message_id long, term string")
    assert sorted(tuple(r) for r in knowledge.unmatched(mentions, known).collect()) == [(1, "galaxy s24"), (2, "galaxy s24"), (4, "galaxy s24")]


def test_component_enrichment(spark):
    parts = [("Core i5-13420H", "Procesador", "Núcleos", "8"), ("i5-13420h", "Procesador", "Hilos", "12"), ("RTX 4060", "Video", "VRAM", "8 GB")]
    components = spark.createDataFrame(parts, "alias string, section string, label string, value string")
    products = spark.createDataFrame([(1, "Notebook Intel Core I5 13420H rtx-4060ti"), (2, "Mouse"), (3, None)], "id long, name string")
    known = spark.createDataFrame([(1, "PROCESADOR", "nucleos")], "product_id long, section string, label string")
    assert sorted(tuple(r) for r in specs.enriched(products, components, known).collect()) == [(1, "Procesador", "Hilos", "12"), (1, "Video", "VRAM", "8 GB")]


def some_names(rng, n):
    base = ["".join(rng.choice(string.ascii_lowercase[:9] + " 12é") for _ in range(rng.randrange(1, 22))) for _ in range(n // 3)]
    out = list(base)
    for x in base:
        for _ in range(2):
            y = list(x)
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(y) + 1)
                y[at : at + rng.randrange(2)] = rng.choice(["", "z", "ab"])
            out.append("".join(y))
    return [x for x in out if x]


@pytest.mark.parametrize("least", [0.5, 0.72, 0.8, 0.92])
def test_similar_names(spark, least):
    rng = random.Random(int(least * 100))
    left, right = ([(rng.choice("gh"), x) for x in some_names(rng, 60)] for _ in range(2))
    right += [(g, x[1:] + "q") for g, x in left[:40] if len(x) > 1] + left[:5] + [("g", None), (None, "x")]
    df = lambda rows: spark.createDataFrame(rows, "group string, name string")
    got = {(r["group"], r["a"], r["b"]) for r in names.similar_names(df(left), df(right), least).collect()}
    want = {(g, a, b) for g, a in set(left) for h, b in set(right) if g == h and a and b and SequenceMatcher(None, a, b).ratio() >= least}
    assert got == want and want


def test_similar_names_do_not_meet_all_pairs(spark):
    """Of the pairs of one brand's names very few are looked at."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randrange(12, 24)))
    rows = [("brand", word()) for _ in range(1000)]
    df = lambda n: spark.createDataFrame(rows[:n], "group string, name string")
    few, many = (names.possible_pairs(df(n), df(n), 0.8).count() for n in (300, 1000))
    assert 300 <= few and many < 0.02 * 1000**2, (few, many)


def test_ladder_ends_in_similar_names(spark):
    schema = "id long, gtin string, brand string, mpn string, model string, sku string, sku_is_identity boolean, name string"
    products = [(1, None, "Acer", None, None, None, False, "Aspire Lite 15"), (2, None, "ACER", None, None, None, False, "Aspire Lite 14"), (3, "12345678", "Asus", None, None, None, False, "Zenbook")]
    offers = [(10, None, "acer", None, None, None, False, "aspire lite 15"), (11, "12345678", "asus", None, None, None, False, "zen"), (12, None, "acer", None, None, None, False, "tv"), (13, None, None, None, None, None, False, "aspire lite 15")]
    frame = lambda rows, name: spark.createDataFrame(rows, schema).withColumnRenamed("id", name)
    out = {r["offer_id"]: r for r in identity.match_or_similar(frame(offers, "offer_id"), frame(products, "product_id")).collect()}
    assert (out[10]["status"], out[10]["strategy"], out[10]["product_id"], out[10]["candidates"]) == ("AMBIGUOUS", "fuzzy_high", None, [1, 2])
    assert (out[11]["status"], out[11]["product_id"]) == ("MATCH", 3) and [out[i]["status"] for i in (12, 13)] == ["NO_MATCH"] * 2
    gate = {r["offer_id"]: r["ask"] for r in knowledge.ask_model(identity.match_or_similar(frame(offers, "offer_id"), frame(products, "product_id"))).collect()}
    assert gate == {10: True, 11: False, 12: False, 13: False}


def test_closure_of_long_chains_and_cycles(spark):
    ring = [(2000 + i, 2000 + (i + 1) % 7) for i in range(7)] + [(2010, 2003), (2020, 2020), (3000, 9999)]
    tree = spark.createDataFrame([(i, i - 1 if i else None) for i in range(1000)] + ring, "id long, parent_id long")
    found = catalog.closure(tree)
    parent, want = dict(ring), {}
    for i in parent:
        at, d = i, 0
        while at is not None and (i, at) not in want:
            want[i, at] = d
            at, d = parent.get(at), d + 1
    assert {(r["id"], r["ancestor_id"]): r["distance"] for r in found.where("id >= 2000").collect()} == want
    chain = found.where("id < 1000").agg(F.count(F.lit(1)), F.count_if(F.expr("distance = id - ancestor_id")), F.max("distance")).first()
    assert tuple(chain) == (500500, 500500, 999) and found.where("ancestor_id = 990").count() == 10


def test_unmarked(spark):
    words = ["ﬁtbit", "Ｓｏｎｙ", "Straße", "ÉCRAN", "ĳs", "Ⅷ", "ς", "plain", "日本", "", "İ"]
    folded = lambda w: "".join(x for x in unicodedata.normalize("NFKD", w.casefold()) if not unicodedata.combining(x)).casefold()
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.unmarked(F.col("w"))).collect()]
    assert got == [folded(w) for w in words]


def test_numeric_hosts(spark):
    bad = ["http://2130706433/", "http://0x7f000001/", "http://0177.0.0.1/", "http://127.1/", "http://0x7f.1", "http://10.0.0.1.", "http://192.168.257/", "http://4294967296/", "http://256.1.1.1/", "http://09.1.1.1/", "http://localhost./", "http://[::1]/", "http://169.254.169.254/", "http://100.64.0.1/", "http://0/", "http://172.31.255.255/", "http://user@10.1.1.1/", "ftp://a.example/"]
    good = ["https://8.8.8.8/", "http://0x08080808/", "http://134744072/", "http://010.8.8.8/", "http://172.32.0.1/", "http://a.example/x", "http://1e100.net/", "http://127.example.com/", "http://10.0.0.1.example.org/"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(u,) for u in bad + good], "u string").select("u", urls.safe_to_fetch(F.col("u"))).collect()}
    assert [u for u in bad if got[u]] == [] and [u for u in good if not got[u]] == []
