"""What a message wants, given the products that the conversation is about."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import folded, peso_amount
from lodestone.operators.dialog import INTENTS
from lodestone.operators.entities import referred

# Phrases by which a follow-up is told, what it then wants (in this order), further signs of a comparison and of a search, and greetings.
FOLLOWS = (
    "comparal", "comparame", "comparame los", "ese", "esa", "el primero", "el segundo", "la primera", "la segunda", "y contra", "cual es mejor", "cual me conviene", "por que", "que tiene",
)
_COMPARE, _SPEC = dict(INTENTS)["compare"], dict(INTENTS)["specification"]
BETTER, BETWEEN = "es mejor", (" o ", "entre ", "contra ", " vs ")
FOLLOWED = (
    ("recommend", ("me conviene", "recomienda", "recomiendame", "cual elegir", "mejor para mi", "vale la pena", "cual es mejor", "mejor opcion")),
    ("compare", _COMPARE),
    ("follow_up", ("por que", "porque", "explica")),
    ("specification", (*(p for p in _SPEC if p != "cual tiene mejor"), "cual tiene mejor")),
    ("price_check", ("cuanto cuesta", "cuanto vale", "cuanto val", "precio", "barat", "econom", "lucas")),
)
SEARCH_WORDS = ("un", "una", "algún", "alguno", "alguna", "los", "soy", "necesito")
GREETINGS = ("hola", "buenas", "hey", "buenos dias", "buenas tardes", "que tal", "hello", "hi")


def intent_in_context(text: Column, active: Column, names: Column) -> Column:
    """(intent, confidence, clarify) of a message, the products it may refer to (``active``, an array) and whether it names a product, brand or category.

    With products, a message that refers to one of them or sounds like a follow-up is judged as such; else the first rule of INTENTS
    that fits decides. A price or a name makes a search. An empty message is a question to be asked again, a greeting is
    general with a confidence of 0.98. Null texts and arrays are empty, a null ``names`` is false.
    """
    raw = F.trim(F.coalesce(text, F.lit("")))
    said = folded(raw)
    has = lambda phrases: reduce(Column.__or__, [said.contains(p) for p in phrases])
    compares = has([BETTER]) & has(BETWEEN)
    fits = {name: has(phrases) | compares if name == "compare" else has(phrases) for name, phrases in INTENTS}
    fits["search"] |= F.arrays_overlap(F.split(F.lower(raw), r"\s+"), F.array(*map(F.lit, SEARCH_WORDS))) | peso_amount(raw).isNotNull() | F.coalesce(names, F.lit(False))
    follows = (F.size(F.coalesce(active, F.array().cast("array<bigint>"))) > 0) & ((F.size(referred(raw, active)) > 0) | has(FOLLOWS))
    then = F.coalesce(*[F.when((has(phrases) | compares) if name == "compare" else has(phrases), name) for name, phrases in FOLLOWED], F.lit("follow_up"))
    wanted = F.when(follows, then).otherwise(F.coalesce(*[F.when(test, name) for name, test in fits.items()], F.lit("general_question")))
    general = wanted == "general_question"
    sure = F.when(general & said.isin(*GREETINGS), 0.98).otherwise(1.0)
    return F.struct(wanted.alias("intent"), sure.alias("confidence"), (general & (F.length(raw) == 0)).alias("clarify"))
