"""Intents with and without products that the conversation is about."""

from pyspark.sql import functions as F

from lodestone.operators.intents import intent_in_context

CASES = [
    ("cual es mejor?", [1, 2], False, "recommend"), ("cual es mejor?", [], False, "compare"), ("compara los dos", [1, 2], False, "compare"), ("por que ese", [1], False, "follow_up"),
    ("y el segundo, que tiene?", [1, 2], False, "specification"), ("ese a que precio", [1], False, "price_check"), ("el segundo", [1, 2], False, "follow_up"),
    ("el tercero", [1, 2], False, "general_question"), ("el asus es mejor o el dell", None, False, "compare"), ("Apple", None, True, "search"), ("algo de 500 lucas", None, False, "price_check"),
    ("500000", None, False, "search"), ("necesito ayuda", None, False, "search"), ("sirve con mi placa", [1], False, "compatibility"), ("Hola", [1], None, "general_question"),
    ("", [1], False, "general_question"), (None, None, None, "general_question"), ("me recomiendas algo", None, False, "recommend"),
]


def test_intents_in_context(spark):
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, text string, active array<long>, names boolean")
    got = rows.orderBy("i").select("text", intent_in_context(F.col("text"), F.col("active"), F.col("names")).alias("x")).collect()
    assert [(r["text"], r["x"]["intent"]) for r in got] == [(c[0], c[3]) for c in CASES]
    assert {r["text"] for r in got if r["x"]["clarify"]} == {"", None} and [r["text"] for r in got if r["x"]["confidence"] < 1] == ["Hola"]
