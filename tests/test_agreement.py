"""Agreement and conflict within units and variants, against pairwise comparison."""

import random
import re
from itertools import combinations

from pyspark.sql import functions as F

from lodestone.functions.text import quantities
from lodestone.operators import agreement as a


def test_quantities_and_equivalence(spark):
    rows = spark.createDataFrame([("270W y 16 Gigas, 6,1\" 50%", None), (None, None), ("16 GB", "16 gigabytes"), ("16 GB", "32 GB"), ("Rápido", "rapido "), ("", ""), ("16 GB", "rápido")], "a string, b string")
    got = rows.select(quantities(F.col("a")).alias("q"), a.equivalent(F.col("a"), F.col("b")).alias("same")).collect()
    assert {tuple(x) for x in got[0]["q"]} == {(270.0, "w"), (16.0, "gb"), (6.1, '"'), (50.0, "%")} and got[1]["q"] == []
    assert [r["same"] for r in got] == [False, False, True, False, True, False, False]


def test_variants(spark):
    model = lambda m, t: (m, t)
    cases = [
        (model("POCO X6", "Poco X6 5G 256 global"), True), (model("POCO X6", "POCO X6 Pro"), False), (model("iPhone 15 Pro", "iPhone 15"), False),
        (model("RTX 5070", "NVIDIA RTX 5070 Ti"), False), (model("", "x"), False), (model("RTX 5070", "rtx-5070, 12 GB"), True),
    ]
    rows = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, m string, t string")
    got = rows.orderBy("i").select(a.same_variant(a.words(F.col("m")), a.words(F.col("t")))).collect()
    assert [r[0] for r in got] == [c[1] for c in cases]


def test_verdicts(spark):
    items = [
        ("tdp", "RTX 4060", "consumo de 270W", 0.9), ("tdp", "ficha", "RTX 4060: 270 watts", 0.7),
        ("ram", "x", "8 GB", 0.9), ("ram", "y", "16 GB", 0.5), ("other", "X6 Pro", "12 GB", 0.9), ("far", "Nokia", "1 GB", 0.9),
        ("text", "Buena", "cámara", 0.93), ("text", "BUENA ", "camara", 0.5), ("mixed", "buena", None, 0.9), ("mixed", None, "mala", None), ("stray", "5 GB", "", 0.9),
        ("units", "5 GB", "", 0.6), ("units", None, "7 W", 0.6), ("units", None, "palabras", 0.6),
    ]
    claims = [("tdp", "RTX 4060"), ("tdp", "RTX 4060"), ("ram", None), ("other", "X6"), ("far", "X6"), ("text", ""), ("mixed", None), ("none", None), ("units", None)]
    got = a.classified(spark.createDataFrame(items, "claim string, title string, content string, confidence double"), spark.createDataFrame(claims, "claim string, model string"))
    assert {r["claim"]: (r["items"], r["mismatched"], r["verdict"], r["confidence"]) for r in got.collect()} == {
        "tdp": (2, 0, "agreement", 0.95), "ram": (2, 0, "conflict", 0.0), "other": (0, 1, "variant_mismatch", 0.0), "far": (0, 0, "insufficient_evidence", 0.0),
        "text": (2, 0, "agreement", 0.9), "mixed": (2, 0, "insufficient_evidence", 0.0), "none": (0, 0, "insufficient_evidence", 0.0), "units": (3, 0, "agreement", 0.75),
    }
    assert got.count() == 8
    empty = a.classified(spark.createDataFrame([], "claim string, title string, content string, confidence double"), spark.createDataFrame([], "claim string, model string"))
    assert empty.count() == 0


def test_conflicts_as_by_pairs(spark):
    """Random lists of values, triangles without a common value among them; a hot claim; every pair is compared here."""
    rng = random.Random(5)
    rows = []
    for claim in range(150):
        for _ in range(rng.randint(1, 5)):
            rows.append((claim, [(float(rng.randint(1, 4)), rng.choice("gw")) for _ in range(rng.randint(0, 4))]))
    rows += [(900, [(x, "g"), (y, "g")]) for x, y in ((1.0, 2.0), (2.0, 3.0), (1.0, 3.0))] * 300
    rows += [(901, [(x, "g"), (y, "g")]) for x, y in ((1.0, 2.0), (2.0, 3.0), (1.0, 3.0), (3.0, 4.0))]

    def clash(p, q):
        by = lambda s: {u: {v for v, w in s if w == u} for _, u in s}
        p, q = by(p), by(q)
        return any(not p[u] & q[u] for u in p.keys() & q.keys())

    want = {c for c in {r[0] for r in rows} if any(clash(p, q) for p, q in combinations({tuple(r[1]) for r in rows if r[0] == c}, 2))}
    got = a.conflicting_claims(spark.createDataFrame(rows, "claim int, said array<struct<value:double,unit:string>>")).collect()
    assert {r[0] for r in got} == want and len(got) == len(want) and 900 not in want and 901 in want
    assert re.fullmatch("[a-z]+", a.VARIANT_WORDS[0])


def test_items_with_one_text_are_read_once(spark, monkeypatch):
    """3000 items of two claims with five texts each, two of them the same for both."""
    rows = {}
    monkeypatch.setattr(a, "written", lambda df, name: rows.update({name: df.count()}) or df)
    items = spark.range(3000).selectExpr("id % 2 AS claim", "'Poco X6' AS title", "concat(if(id % 10 < 4, 0, id % 2), id div 2 % 5, ' g') AS content", "0.5d + if(id = 17, 0.2d, 0d) AS confidence")
    claims = spark.createDataFrame([(0, "Poco X6"), (1, ""), (2, None)], "claim long, model string")
    got = sorted(tuple(r) for r in a.classified(items, claims).collect())
    assert got == [(0, "Poco X6", 1500, 0, "conflict", 0.0), (1, "", 1500, 0, "conflict", 0.0), (2, "", 0, 0, "insufficient_evidence", 0.0)]
    assert rows["evidence"] == 10 and rows["read"] == 8 and rows["lists"] == 10
