"""Agreement and conflict of evidence, claims and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def verdicts(evidence: DataFrame) -> DataFrame:
    """Per claim, from (claim, value, source): insufficient without a value, agreement if all values are one, else conflict; with the number of supporters and of conflicting pairs of items.

    The pairs are counted from the sizes of the groups of equal values, never made.
    """
    sizes = evidence.where("value is not null").groupBy("claim", "value").agg(F.count(F.lit(1)).alias("n"))
    per = sizes.groupBy("claim").agg(F.sum("n").alias("items"), F.max("n").alias("supporters"), F.count(F.lit(1)).alias("variants"), F.sum(F.col("n") * F.col("n")).alias("_sq"))
    met = evidence.select("claim").distinct().join(per, "claim", "left")
    verdict = F.when(F.col("items").isNull(), "insufficient").when(F.col("variants") == 1, "agreement").otherwise("conflict")
    pairs = F.floor((F.col("items") * F.col("items") - F.col("_sq")) / 2).cast("bigint")
    return met.select("claim", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("supporters", F.lit(0)).alias("supporters"), F.coalesce(pairs, F.lit(0)).alias("conflicting_pairs"), verdict.alias("verdict"))


def claim_weight(priority: Column, confidence: Column, days: Column) -> Column:
    """Half the source's priority, 0.3 its confidence, 0.2 its freshness over 90 days."""
    fresh = F.coalesce(F.greatest(F.lit(0.0), 1 - days / 90.0), F.lit(0.0))
    return F.lit(0.5) * priority / F.lit(60.0) + F.lit(0.3) * confidence + F.lit(0.2) * fresh


def resolved(evidence: DataFrame, margin: float = 0.05) -> DataFrame:
    """Per claim the value with the greatest weight, from (claim, value, weight); decided if it leads the next value by the margin. Only two rows of a claim are ever ranked."""
    best = evidence.groupBy("claim", "value").agg(F.max("weight").alias("weight"))
    order = Window.partitionBy("claim").orderBy(F.desc("weight"), "value")
    top = best.withColumn("n", F.row_number().over(order)).where("n <= 2")
    sides = top.groupBy("claim").agg(F.max(F.when(F.col("n") == 1, F.col("value"))).alias("value"), F.max(F.when(F.col("n") == 1, F.col("weight"))).alias("weight"), F.max(F.when(F.col("n") == 2, F.col("weight"))).alias("next"))
    return sides.select("claim", "value", F.round("weight", 6).alias("weight"), (F.col("next").isNull() | (F.col("weight") - F.col("next") >= margin)).alias("decided"))


def recommendation(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Products by the weighted sum of value / best value of each criterion, from (group_id, product_id, criterion, value). Criteria without a positive best value add nothing."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    best = scores.groupBy("group_id", "criterion").agg(F.max("value").alias("best")).where("best > 0")
    graded = scores.join(best, ["group_id", "criterion"]).withColumn("part", F.col("value") / F.col("best") * F.coalesce(weight[F.col("criterion")], F.lit(0.0)))
    total = graded.groupBy("group_id", "product_id").agg(F.round(F.sum("part"), 6).alias("score"))
    order = Window.partitionBy("group_id").orderBy(F.desc("score"), "product_id")
    return total.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def coverage_confidence(present: Column, wanted: Column) -> Column:
    return F.least(F.lit(0.95), 0.4 + 0.55 * present / wanted)
