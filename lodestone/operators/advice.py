"""What advice is made of: weights by use case, winners and their confidence, summaries, sections of evidence, search results."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import folded
from lodestone.operators.admin import filter_or_all

# What a criterion weighs, and which criteria a use case adds.
WEIGHT_VALUES = {"high": 3.0, "medium": 1.5, "low": 0.5}
BASE_WEIGHTS = {"value": "high", "price": "high", "rating": "medium"}
USE_WEIGHTS = {
    "gaming": {"gaming": "high", "performance": "high", "price_value": "high"},
    "camera": {"camera": "high", "performance": "medium", "price_value": "medium"},
    "battery": {"battery": "high", "price_value": "medium"},
    "productivity": {"performance": "high", "price_value": "high", "productivity": "high"},
    "price_value": {"price_value": "high", "value": "high"},
    "longevity": {"longevity": "high", "performance": "medium"},
}
# Parts of labels of which less is better.
LESS_IS_BETTER = ("consumo", "tdp", "peso", "latencia", "grosor", "time", "acceso", "disipador")
# How a verdict is put to a reader.
VERDICT_WORDS = {"agreement": "apoya", "conflict": "CONFLICTO", "variant_mismatch": "no aplica a la variante", "insufficient": "sin confirmar"}


def weights_for(use_cases: Iterable[str], labels: Iterable[str] = (), *, objective: bool = False) -> dict[str, str]:
    """Criteria and their weights: the basis, the heavier of the use cases, and the labels that products share: medium if nothing else is said, high for an objective comparison."""
    heavier = lambda a, c: max(a, c, key=WEIGHT_VALUES.get) if a else c
    found = dict(BASE_WEIGHTS)
    for use in use_cases:
        for label, weight in USE_WEIGHTS.get(use, {}).items():
            found[label] = heavier(found.get(label), weight)
    return found | {label: "high" if objective else found.get(label, "medium") for label in labels}


def direction(label: Column) -> Column:
    """-1 if less of it is better, else 1."""
    said = F.lower(label)
    less = reduce(Column.__or__, [said.contains(part) for part in LESS_IS_BETTER])
    return F.when(label == "price", -1).when(label.isin("value", "rating"), 1).when(less, -1).otherwise(1)


def advised(products: DataFrame, values: DataFrame, weights: dict[str, str], max_price: int | None = None) -> DataFrame:
    """One product of each group by the weighted sum of grade / best grade: group_id, product_id, score, confidence, unknowns.

    products: group_id, product_id, price; values: group_id, product_id, label, number. Grades are numbers times their direction, and a
    criterion without a positive best grade adds nothing. Of products over the price none wins while another in the group is within it.
    Confidence grows from 0.4 by 0.55 times the share of products and criteria with a number, up to 0.95; unknowns are up to ten criteria
    that some product lacks, in order. Ties go to the smaller id. Groups are aggregated, never gathered.
    """
    spark = products.sparkSession
    criteria = spark.createDataFrame([(label, WEIGHT_VALUES.get(w, 1.0)) for label, w in weights.items()], "label string, weight double")
    graded = values.where("number is not null").join(F.broadcast(criteria), "label").withColumn("grade", F.col("number").cast("double") * direction(F.col("label")))
    best = graded.groupBy("group_id", "label").agg(F.max("grade").alias("best"), F.count(F.lit(1)).alias("known"))
    part = F.when(F.col("best") > 0, F.col("grade") / F.col("best") * F.col("weight")).otherwise(0.0)
    sums = graded.join(best, ["group_id", "label"]).groupBy("group_id", "product_id").agg(F.sum(part).alias("sum"))
    eligible = products if max_price is None else filter_or_all(products, F.coalesce("price", F.lit(0)) <= max_price, "group_id")
    scored = eligible.select("group_id", "product_id").join(sums, ["group_id", "product_id"], "left").select("group_id", "product_id", F.round(F.coalesce("sum", F.lit(0.0)), 6).alias("score"))
    first = F.min(F.struct((-F.col("score")).alias("minus"), "product_id")).alias("w")
    winners = scored.groupBy("group_id").agg(first).select("group_id", "w.product_id", (-F.col("w.minus")).alias("score"))
    sizes = products.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(label).alias("label")) for i, label in enumerate(weights)])).alias("c")
    each = sizes.select("group_id", "n", every).select("group_id", "n", "c.*").join(best.select("group_id", "label", "known"), ["group_id", "label"], "left")
    lacking = F.array_sort(F.collect_list(F.when(F.coalesce("known", F.lit(0)) < F.col("n"), F.struct("place", "label"))))
    coverage = F.sum(F.coalesce("known", F.lit(0))) / F.sum("n")
    covered = each.groupBy("group_id").agg(F.round(F.least(F.lit(0.95), F.lit(0.4) + F.lit(0.55) * coverage), 3).alias("confidence"), F.slice(F.transform(lacking, lambda s: s["label"]), 1, 10).alias("unknowns"))
    return winners.join(covered, "group_id")


def strengths(values: DataFrame) -> DataFrame:
    """(group_id, label, product_id): the product with the best grade of each label, the smallest id of equal ones."""
    graded = values.where("number is not null").withColumn("grade", F.col("number").cast("double") * direction(F.col("label")))
    first = F.min(F.struct((-F.col("grade")).alias("minus"), "product_id")).alias("w")
    return graded.groupBy("group_id", "label").agg(first).select("group_id", "label", "w.product_id")


def merged_value(label: Column, current: Column, following: Column) -> Column:
    """Two values to show under one label: one that holds the other, core frequencies by their numbers, else both with a stroke between."""
    a, c = F.lower(current), F.lower(following)
    both = F.concat_ws(" / ", current, following)
    speeds = F.array_distinct(F.regexp_extract_all(both, F.lit(r"(?i)([0-9]{3,5})\s*MHz"), F.lit(1)))
    known = F.exists(F.split(current, " / "), lambda p: c.contains(F.lower(F.trim(p))) | F.lower(p).contains(c))
    return (
        F.when(a.contains(c), current).when(c.contains(a), following)
        .when((folded(label) == "frecuencias core") & (F.size(speeds) > 1), F.concat(F.array_join(speeds, " / "), F.lit(" MHz")))
        .when(known, current).otherwise(both)
    )


def summary(items: DataFrame) -> DataFrame:
    """One value for each label of a product, from (product_id, place, label, value): values of labels that differ in case or marks only are merged in order of their place. A product has as many as it has labels."""
    kept = items.where("trim(value) <> ''").withColumn("key", folded(F.trim("label")))
    rows = F.array_sort(F.collect_list(F.struct("place", "label", F.trim("value").alias("value"))))
    per = kept.groupBy("product_id", "key").agg(rows.alias("rows"))
    first = F.col("rows")[0]
    value = F.aggregate(F.slice("rows", 2, 1 << 30), first["value"], lambda s, x: merged_value(first["label"], s, x["value"]))
    return per.select("product_id", first["label"].alias("label"), value.alias("value"))


def sections(items: DataFrame, verdicts: DataFrame, most: int = 20) -> DataFrame:
    """A block of text for each claim: its verdict, then ``most`` sources at most, which a prompt has room for, those in favour first.

    items: claim, supports (boolean), source_name, source_url; verdicts: claim, verdict.
    """
    side = F.when(F.col("supports"), "apoya").otherwise("en contra")
    named = F.when(F.length("source_url") > 0, F.concat(F.lit("["), "source_name", F.lit("]("), "source_url", F.lit(")"))).otherwise(F.col("source_name"))
    lines = items.select("claim", F.when(F.col("supports"), 0).otherwise(1).alias("side"), F.concat(F.lit("  · "), side, F.lit(" "), named).alias("line"))
    order = Window.partitionBy("claim").orderBy("side", "line")
    few = lines.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    text = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    said = F.coalesce(F.create_map(*[F.lit(x) for pair in VERDICT_WORDS.items() for x in pair])[F.col("verdict")], F.lit("sin evidencia"))
    head = F.concat(F.lit("- "), "claim", F.lit(": "), said)
    met = verdicts.join(few.groupBy("claim").agg(text.alias("lines")), "claim", "left")
    return met.select("claim", F.array_join(F.concat(F.array(head), F.coalesce("lines", F.array().cast("array<string>"))), "\n").alias("section"))


def search_results(html: Column, most: int = 5) -> Column:
    """Up to ``most`` results (title, url, snippet) of a result page: anchors of the class result__a, their target out of the redirecting address, and the snippet that follows."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    parts = F.slice(F.split(html, r'(?i)(?=<a\s[^>]*class="[^"]*\bresult__a\b)'), 2, most)

    def read(part: Column) -> Column:
        anchor = F.regexp_extract(part, r"(?is)^(<a\s[^>]*>)", 1)
        href = F.regexp_replace(F.regexp_extract(anchor, r'(?is)\shref="([^"]*)"', 1), "&amp;", "&")
        packed = F.regexp_extract(href, "[?&]uddg=([^&#]*)", 1)
        url = F.when(packed != "", F.coalesce(F.try_url_decode(packed), packed)).otherwise(href)
        return F.struct(plain(F.regexp_extract(part, r"(?is)^<a\s[^>]*>(.*?)</a>", 1)).alias("title"), url.alias("url"), plain(F.regexp_extract(part, r'(?is)class="[^"]*\bresult__snippet\b[^"]*"[^>]*>(.*?)</(?:a|div|td)>', 1)).alias("snippet"))

    return F.filter(F.transform(parts, read), lambda r: (r["title"] != "") & (r["url"] != ""))


def largest_stated(text: Column, words: tuple[str, ...], unit: str) -> Column:
    """The largest number of three to five digits with the unit that follows one of the words, within 40 characters without digits."""
    pattern = "(?i)(?:" + "|".join(words) + r")[^0-9]{0,40}([0-9]{3,5})\s*" + unit
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: n.cast("bigint")))


def in_order(products: DataFrame, ids: list[int]) -> DataFrame:
    """The products asked for with their place in the list."""
    wanted = products.where(F.col("id").isin(ids))
    return wanted.withColumn("place", F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("id")).cast("int"))


def answered(asked: DataFrame, model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], key: str = "offer_id") -> DataFrame:
    """Answers of an injected model to the rows of asked, batch by batch: (key, decision, product_id, confidence, reason).

    ``model`` takes and gives an iterator of frames, so that a client is opened once a task. A row that it does not answer is ambiguous.
    """
    given = asked.mapInPandas(model, f"{key} long, decision string, product_id long, confidence double, reason string")
    once = given.groupBy(key).agg(F.min(F.struct("decision", "product_id", "confidence", "reason")).alias("a"))
    met = asked.select(key).join(once, key, "left")
    return met.select(key, F.coalesce("a.decision", F.lit("AMBIGUOUS")).alias("decision"), "a.product_id", F.coalesce("a.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("a.reason", F.lit("no answer")).alias("reason"))
