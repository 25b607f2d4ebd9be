"""Queries of conversations and memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import bindings as b
from lodestone.operators import dialog as d
from lodestone.operators import intents as it
from lodestone.operators import retrieval as r
from lodestone.registry import query

_SAID = "translate(lower(coalesce(text, '')), 'áéíóúüñ', 'aeiouun')"
_INTENT = "CASE " + " ".join("WHEN " + " OR ".join(f"contains({_SAID}, '{p}')" for p in phrases) + f" THEN '{name}'" for name, phrases in d.INTENTS) + " ELSE 'general_question' END"


@query(f"SELECT conv_id, turn, {_INTENT} AS intent FROM conversations WHERE role = 'user'")
def intent_tags(spark, sf_dir):
    return b.table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", d.intent(F.col("text")).alias("intent"))


_CALLS = ("y el segundo?", "los dos", "todos por favor", "ese sirve", "la quinta", "hola", "la tercera o la cuarta", "ambas")
_CALL = "lower(trim((" + str(list(_CALLS)) + ")[1 + length(text) % 8] || ' ' || text))"
_ORDINAL = " ".join(f"WHEN regexp_matches(s, '\\b{word}\\b') THEN {[i] if i < 3 else []}" for word, i in d.ORDINALS)


@query(f"SELECT conv_id, turn, CASE WHEN regexp_matches(s, 'las dos|los dos|ambas|ambos|esas dos|eses dos|ese par') THEN [0, 1] WHEN regexp_matches(s, 'todos|todas') THEN [0, 1, 2] {_ORDINAL} WHEN regexp_matches(s, '^(ese|esa|aquel)') THEN [0] ELSE [] END::INTEGER[] AS refs FROM (SELECT *, {_CALL} AS s FROM conversations WHERE text IS NOT NULL)")
def reference_indices(spark, sf_dir):
    """Turns that begin with a phrase chosen by their length, as the invented texts refer to nothing."""
    called = F.element_at(F.array(*map(F.lit, _CALLS)), (F.length("text") % len(_CALLS) + 1).cast("int"))
    turns = b.table(spark, sf_dir, "conversations").where("text is not null")
    return turns.select("conv_id", "turn", d.references(F.concat_ws(" ", called, "text"), 3).alias("refs"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'assistant' AND length(text) % 2 = 0 THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::INTEGER AS active FROM conversations")
def active_carry_forward(spark, sf_dir):
    """Assistant turns of even length name products, for which their length stands in."""
    turns = b.table(spark, sf_dir, "conversations")
    named = F.when(F.length("text") % 2 == 0, F.length("text"))
    return d.carried(turns, named).select("conv_id", "turn", "active")


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations), s AS (SELECT *, min(turn) FILTER (WHERE n <= 3) OVER (PARTITION BY conv_id) AS st FROM n), u AS (SELECT *, max(turn) FILTER (WHERE role = 'user' AND turn <= st) OVER (PARTITION BY conv_id) AS us FROM s) SELECT conv_id, turn, role FROM u WHERE turn >= coalesce(us, st)")
def dialog_window(spark, sf_dir):
    return d.window(b.table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role")


@query("WITH u AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations WHERE role = 'user') SELECT conv_id, turn, CASE WHEN previous IS NOT NULL AND previous <> text THEN previous || ' ' || text ELSE text END AS query FROM u")
def followup_rewrite(spark, sf_dir):
    return d.rewritten(b.table(spark, sf_dir, "conversations")).select("conv_id", "turn", "query")


@query(
    "WITH p AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS x FROM orders) SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN x * 1000 WHEN 1 THEN x // 10 * 1000 WHEN 2 THEN CASE WHEN x >= 1000 THEN x END WHEN 3 THEN x ELSE CASE WHEN x % 2000 >= 1000 THEN x % 2000 END END AS max_price FROM p"
)
def peso_amounts(spark, sf_dir):
    """Sums of orders as people write them: in lucas, in thousands, with points, as pesos, as a bare number."""
    from lodestone.functions.text import peso_amount

    x, form = F.floor("o_totalprice"), F.col("o_orderkey") % 5
    text = lambda c: c.cast("string")
    said = (
        F.when(form == 0, F.concat(F.lit("hasta "), text(x), F.lit(" lucas"))).when(form == 1, F.concat(F.lit("unos "), text(F.floor(x / 10)), F.lit(" mil")))
        .when(form == 2, F.concat(F.lit("$"), F.translate(F.format_number(x, 0), ",", "."))).when(form == 3, F.concat(F.lit("vale "), text(x), F.lit(" pesos")))
        .otherwise(F.concat(F.lit("quiero "), text(x % 2000)))
    )
    return b.table(spark, sf_dir, "orders").select("o_orderkey", peso_amount(said).alias("max_price"))


@query()
def declared_preferences(spark, sf_dir):
    """Sentences in which users state a lasting preference; a cue is put before some turns, as the invented texts hold none. The tests hold budget and preferences against cases."""
    turns = b.table(spark, sf_dir, "conversations").where("role = 'user'")
    said = F.concat(F.when(F.col("turn") % 4 == 0, "Prefiero pagar hasta 300 lucas. ").otherwise(""), F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", d.preferences(said).alias("preferences"), d.budget(said).alias("budget"))


_MEM = "list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: length(x) > 2)"


@query(
    f"WITH m AS (SELECT conv_id AS user_id, turn AS memory_id, {_MEM} AS own, 1 + turn % 5 AS importance, turn AS age FROM conversations), l AS (SELECT *, CASE WHEN len(own) > 0 THEN len(list_intersect(own, ['the', 'tion', 'and'])) / sqrt(len(own)::DOUBLE * 3) ELSE 0.0::DOUBLE END AS likeness FROM m), s AS (SELECT user_id, memory_id, round(0.75::DOUBLE * likeness + 0.15::DOUBLE * importance / 5.0::DOUBLE + 0.1::DOUBLE * pow(0.5::DOUBLE, age / 45.0::DOUBLE), 6) AS score FROM l WHERE likeness >= 0.12::DOUBLE), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, memory_id)::INTEGER AS rank FROM s) SELECT * FROM r WHERE rank <= 4"
)
def memory_topk(spark, sf_dir):
    """Turns as memories that are as many days old as their number."""
    as_of = F.expr("timestamp'2024-02-01 00:00:00'")
    memories = b.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("user_id"), F.col("turn").alias("memory_id"), F.col("text").alias("content"), (1 + F.col("turn") % 5).alias("importance"), F.timestamp_add("DAY", -F.col("turn").cast("int"), as_of).alias("created_at"))
    return r.memory_search(memories, ["the", "tion", "and"], as_of, 4)


_ASKED = ("por que ese?", "cual es mejor?", "y el precio?", "que tiene?", "compara los dos", "vale la pena ese", "necesito algo", "el asus es mejor o el dell", "hola", "todos por favor")
_TURN = "lower(trim((" + str(list(_ASKED)) + ")[1 + length(text) % 10] || ' ' || text))"
_ANY = lambda phrases: "(" + " OR ".join(f"contains(t, '{p}')" for p in phrases) + ")"
_MEANS = {name: _ANY(phrases) for name, phrases in d.INTENTS}
_PAIR = f"(contains(t, '{it.BETTER}') AND {_ANY(it.BETWEEN)})"
_FOLLOWED = " ".join(f"WHEN {_ANY(phrases)}{' OR ' + _PAIR if name == 'compare' else ''} THEN '{name}'" for name, phrases in it.FOLLOWED)
_FIRST = " ".join(
    f"WHEN {test}{' OR ' + _PAIR if name == 'compare' else ''}{f' OR list_has_any(w, {list(it.SEARCH_WORDS)})' if name == 'search' else ''} THEN '{name}'" for name, test in _MEANS.items()
)


@query(
    f"""WITH a AS (SELECT *, coalesce(last_value(CASE WHEN role = 'assistant' THEN length(text) % 4 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS n FROM conversations),
    u AS (SELECT conv_id, turn, n, {_TURN} AS s, translate({_TURN}, 'áéíóúüñ', 'aeiouun') AS t FROM a WHERE role = 'user' AND text IS NOT NULL AND NOT regexp_matches(text, '[0-9]')), w AS (SELECT *, regexp_split_to_array(s, '\\s+') AS w FROM u),
    r AS (SELECT *, n > 0 AND (regexp_matches(s, 'las dos|los dos|ambas|ambos|esas dos|eses dos|ese par|todos|todas|^(ese|esa|aquel)') OR {_ANY(it.FOLLOWS)}
        OR {" OR ".join(f"(n > {i} AND regexp_matches(s, '\\b{word}\\b'))" for word, i in d.ORDINALS)}) AS follows FROM w)
    SELECT conv_id, turn, CASE WHEN follows THEN CASE {_FOLLOWED} ELSE 'follow_up' END ELSE CASE {_FIRST} ELSE 'general_question' END END AS intent FROM r"""
)
def intents_in_context(spark, sf_dir):
    """User turns without digits, behind a phrase chosen by their length, about as many products as the last answer's length modulo 4."""
    turns = b.table(spark, sf_dir, "conversations")
    about = d.carried(turns, F.length("text") % 4)
    n = F.coalesce("active", F.lit(0))
    active = F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), n.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    phrase = F.element_at(F.array(*map(F.lit, _ASKED)), (F.length("text") % len(_ASKED) + 1).cast("int"))
    asked = about.where("role = 'user' and text is not null and not text rlike '[0-9]'")
    found = it.intent_in_context(F.concat_ws(" ", phrase, "text"), active, F.lit(False))
    return asked.select("conv_id", "turn", found["intent"].alias("intent"))
