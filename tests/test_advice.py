"""Advice: weights, winners, summaries, sections, result pages and injected models."""

import pandas as pd
from pyspark.sql import functions as F

from lodestone.operators import advice as a


def test_weights():
    assert a.weights_for([]) == {"value": "high", "price": "high", "rating": "medium"}
    found = a.weights_for(["camera", "gaming"], ["RAM", "performance"])
    assert found["performance"] == "high" and found["price_value"] == "high" and found["RAM"] == "medium"
    assert a.weights_for([], ["rating"], objective=True)["rating"] == "high"
    assert a.weights_for(["nothing known"], []) == a.weights_for([])


def test_advised(spark):
    products = spark.createDataFrame([(1, 1, 100), (1, 2, 500), (2, 3, 900), (2, 4, 800), (3, 5, None)], "group_id int, product_id int, price int")
    values = spark.createDataFrame(
        [(1, 1, "RAM", 8.0), (1, 2, "RAM", 16.0), (1, 1, "Peso", 2.0), (1, 2, "Peso", 1.0), (2, 3, "RAM", 4.0), (2, 4, "RAM", 4.0), (2, 4, "Peso", None), (3, 5, "other", 1.0)], "group_id int, product_id int, label string, number double"
    )
    got = {r.group_id: r for r in a.advised(products, values, {"RAM": "high", "Peso": "low"}, 300).collect()}
    # group 1: only product 1 is within the price; weight grades are negative, so they add nothing
    assert (got[1].product_id, got[1].score, got[1].confidence, got[1].unknowns) == (1, 1.5, 0.95, [])
    # group 2: none is within the price, so all take part; equal scores go to the smaller id
    assert (got[2].product_id, got[2].score, got[2].confidence, got[2].unknowns) == (3, 3.0, 0.675, ["Peso"])
    assert (got[3].product_id, got[3].score, got[3].unknowns) == (5, 0.0, ["RAM", "Peso"])
    assert a.advised(products.limit(0), values, {"RAM": "high"}).count() == 0


def test_strengths(spark):
    values = spark.createDataFrame([(1, 1, "latencia", 9.0), (1, 2, "latencia", 7.0), (1, 2, "ram", 8.0), (1, 1, "ram", 8.0), (1, 3, "ram", None)], "group_id int, product_id int, label string, number double")
    assert {r.label: r.product_id for r in a.strengths(values).collect()} == {"latencia": 2, "ram": 1}


def test_summary(spark):
    rows = [(1, 1, "Cámara", "12 MP"), (1, 2, "camara", "12 MP f/1.8"), (1, 3, "CAMARA ", "8 MP"), (1, 4, "camara", "8 mp"), (1, 5, "Color", " "), (1, 6, "Frecuencias core", "2500 MHz"), (1, 7, "frecuencias core", "1800 MHz"), (1, 8, "Color", None)]
    got = {r.label: r.value for r in a.summary(spark.createDataFrame(rows, "product_id int, place int, label string, value string")).collect()}
    assert got == {"Cámara": "12 MP f/1.8 / 8 MP", "Frecuencias core": "2500 / 1800 MHz"}


def test_sections(spark):
    items = spark.createDataFrame([("c", True, "x", "http://x"), ("c", False, "y", None), ("c", True, "z", "")], "claim string, supports boolean, source_name string, source_url string")
    verdicts = spark.createDataFrame([("c", "conflict"), ("d", "insufficient"), ("e", "odd")], "claim string, verdict string")
    got = {r.claim: r.section for r in a.sections(items, verdicts).collect()}
    assert got == {"c": "- c: CONFLICTO\n  · apoya [x](http://x)\n  · apoya z\n  · en contra y", "d": "- d: sin confirmar", "e": "- e: sin evidencia"}
    assert a.sections(items, verdicts, most=1).where("claim = 'c'").first().section.count("\n") == 1


def test_search_results(spark):
    page = (
        '<div class="result"><h2><a rel="nofollow" class="result__a" href="//d.example/l/?uddg=https%3A%2F%2Fa.example%2Fx%3Fq%3D1&amp;rut=2">One <b>two</b></a></h2><a class="result__snippet" href="#">It is <b>here</b></a></div>'
        '<div class="result"><a class="result__a" href="https://b.example/">Plain</a></div><div class="result"><a class="result__a" href="https://c.example/"> </a></div>'
    )
    df = spark.createDataFrame([(page,), ("",), (None,)], "html string").select(a.search_results(F.col("html")).alias("r"))
    got = [[tuple(x) for x in r.r or []] for r in df.collect()]
    assert got == [[("One two", "https://a.example/x?q=1", "It is here"), ("Plain", "https://b.example/", "")], [], []]
    few = spark.createDataFrame([(page,)], "html string").select(a.search_results(F.col("html"), 1).alias("r")).first().r
    assert len(few) == 1


def test_largest_and_order(spark):
    df = spark.createDataFrame([("Boost Clock 2535 MHz, OC mode: 2565MHz, Base 9000 MHz",), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(a.largest_stated(F.col("t"), ("OC mode", "Boost Clock"), "MHz")).collect()] == [2565, None, None]
    got = a.in_order(spark.range(5), [3, 1, 9]).orderBy("place").collect()
    assert [(r.id, r.place) for r in got] == [(3, 1), (1, 2)]


def test_answered(spark):
    def model(batches):
        for rows in batches:
            known = rows[rows["offer_id"] != 2]
            yield pd.DataFrame({"offer_id": known["offer_id"], "decision": "MATCHED", "product_id": known["offer_id"] + 10, "confidence": 0.9, "reason": "sure"})

    got = {r.offer_id: tuple(r)[1:] for r in a.answered(spark.createDataFrame([(1,), (2,)], "offer_id long"), model).collect()}
    assert got == {1: ("MATCHED", 11, 0.9, "sure"), 2: ("AMBIGUOUS", None, 0.0, "no answer")}
