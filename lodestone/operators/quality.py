"""Completeness, coverage, counts, and the life of a specification value."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How far a source is trusted.
SOURCE_PRIORITY = {"admin": 100, "manufacturer": 80, "external": 60, "store": 50, "scraper": 40, "ingestion": 40, "ai": 20, "ai_research": 20, "unknown": 10}


def completeness(products: DataFrame, spec_values: DataFrame, definitions: DataFrame) -> DataFrame:
    """A score up to 100: 15 for the identity (5 for a name, 4 for a brand, 3 for a model, 3 for any of mpn, gtin and sku) and 85 for the share of the definitions that have a value, rounded half to even. Columns that the products lack count as blank."""
    wanted = definitions.select("key").distinct()
    relevant = wanted.agg(F.count(F.lit(1)).alias("n")).scalar()
    has = spec_values.where("value_number is not null or trim(value_text) <> ''").join(F.broadcast(wanted), "key")  # a fixed list of definitions
    per = has.groupBy(F.col("product_id").alias("_p")).agg(F.count_distinct("key").alias("present"))
    met = products.join(per, F.col("id") == F.col("_p"), "left").withColumn("present", F.coalesce("present", F.lit(0)))
    stated = lambda *names: reduce(Column.__or__, [F.coalesce(F.length(n) > 0, F.lit(False)) for n in names if n in products.columns], F.lit(False))
    identity = sum(F.when(stated(*names), points).otherwise(0) for points, names in ((5, ("name",)), (4, ("brand",)), (3, ("model",)), (3, ("mpn", "gtin", "sku"))))
    spec = F.bround(F.col("present") / relevant * 85).cast("int")
    return met.select("id", "name", "present", F.least(F.lit(100), identity + spec).alias("score"))


def extremes(scores: DataFrame, top: int = 20) -> DataFrame:
    """The least and the most complete products."""
    least = scores.orderBy("score", "present", "name", "id").limit(top).withColumn("kind", F.lit("incomplete"))
    most = scores.orderBy(F.desc("score"), F.desc("present"), F.desc("name"), F.desc("id")).limit(top).withColumn("kind", F.lit("complete"))
    return least.unionByName(most)


def coverage(products: DataFrame, spec_values: DataFrame, definitions: DataFrame) -> DataFrame:
    """For each category and definition, how many of its products have a value, in percent."""
    sizes = products.groupBy("category").agg(F.count(F.lit(1)).alias("products"))
    cells = sizes.join(F.broadcast(definitions.select("key").agg(F.collect_list("key").alias("keys"))), F.lit(True)).select("category", "products", F.explode("keys").alias("key"))  # a fixed list of definitions, in one row
    used = spec_values.join(products.select(F.col("id").alias("product_id"), "category"), "product_id").groupBy("category", "key").agg(F.count_distinct("product_id").alias("with_value"))
    met = cells.join(used, ["category", "key"], "left").withColumn("with_value", F.coalesce("with_value", F.lit(0)))
    return met.withColumn("coverage_pct", F.round(F.col("with_value") * 100.0 / F.col("products"), 1))


def without_specs(products: DataFrame, spec_values: DataFrame) -> DataFrame:
    return products.join(spec_values.select(F.col("product_id").alias("id")), "id", "left_anti")


def fully_verified(states: DataFrame) -> DataFrame:
    """Products all of whose values are verified. states: product_id, status."""
    return states.select("product_id").distinct().join(states.where("status <> 'verified'").select("product_id"), "product_id", "left_anti")


def product_status(states: DataFrame) -> DataFrame:
    """conflict if any value's conflict is pending, verified if all are verified, else unverified."""
    status = F.when(F.count_if(F.col("conflict") == "pending") > 0, "conflict").when(F.count_if(F.col("status") != "verified") == 0, "verified").otherwise("unverified")
    return states.groupBy("product_id").agg(status.alias("status"))


def frequencies(df: DataFrame, *cols: str) -> DataFrame:
    """(name, value, n) for several columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in cols])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.name", "p.value").agg(F.count(F.lit(1)).alias("n"))


def snapshot(*, text: Column | None = None, number: Column | None = None, boolean: Column | None = None, json: Column | None = None, unit: Column | None = None) -> Column:
    """A value of any kind as JSON text, alike for equal values: numbers as doubles, the keys of JSON in order."""
    parts = {"text": text, "number": None if number is None else number.cast("double"), "boolean": boolean, "unit": unit}
    parts["json"] = None if json is None else F.to_json(F.try_parse_json(json))
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(parts.items()) if c is not None]))


#: What a source consists of; rows may lack all but the first.
SOURCE = ("source", "source_name", "source_url", "method")


def _rank(status: str, source: str | None) -> int:
    """A verified value has the weight of an administrator's."""
    return SOURCE_PRIORITY["admin"] if status == "verified" else SOURCE_PRIORITY.get(source, SOURCE_PRIORITY["unknown"])


def _upsert(state: dict | None, new: dict) -> tuple[str | None, dict]:
    """What an incoming value does to a key's state: the action, if there is one to record, and the state after it."""
    own = {k: new[k] for k in SOURCE}
    if state is None:
        return "created", {"value": new["value"], **own, "status": new["status"], "conflict": "resolved" if new["status"] == "verified" else "none"}
    stronger = _rank(new["status"], new["source"]) >= _rank(state["status"], state["source"])
    if new["value"] == state["value"]:
        unchanged = new["status"] == state["status"] and all(new[k] == state[k] for k in SOURCE)
        if unchanged or not (new["forced"] or stronger):
            return None, state
        conflict = "resolved" if new["status"] == "verified" else "pending" if state["conflict"] == "pending" else "none"
        return "source_updated", {**state, **own, "status": new["status"], "conflict": conflict}
    if not stronger or (state["status"] == "verified" and new["source"] != "admin"):
        return "conflict_detected", {**state, "conflict": "pending"}
    status = "verified" if new["status"] == "verified" else "review"
    return "value_changed", {"value": new["value"], **own, "status": status, "conflict": "pending"}


def upsert_fold(incoming: DataFrame) -> DataFrame:
    """The history of each (product_id, definition_id) as its values come in by ``seq``.

    Rows have a value (snapshot() makes one of any kind), a source (type, and optionally source_name, source_url, method), a status
    (auto, review or verified; auto by default) and optionally ``forced``. Recorded are: created; source_updated, where the same value
    comes from another source or with another status, and is forced or as trusted; conflict_detected, where a verified value, or one of
    a better source, stands; value_changed. A verified value is trusted like an administrator's. One row per action, with the state after it.
    The values of a task's keys pass by in order, one state at a time, so that a key with very many values needs no more memory than others.
    """
    keys = ("product_id", "definition_id")
    out = ("value", *SOURCE, "status", "conflict")
    schema = "product_id long, definition_id string, seq long, action string, " + ", ".join(f"{c} string" for c in out)
    columns = [*keys, "seq", "value", *SOURCE, "status", "forced"]
    defaults = {**{c: F.lit(None).cast("string") for c in SOURCE}, "status": F.lit("auto"), "forced": F.lit(False)}
    given = [F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults and c in incoming.columns else defaults[c].alias(c) if c in defaults else F.col(c) for c in columns]

    def fold(batches):
        key, state = None, None
        for pdf in batches:
            found = []
            for row in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                own = (row["product_id"], row["definition_id"])
                if own != key:
                    key, state = own, None
                action, state = _upsert(state, row)
                if action:
                    found.append((*own, row["seq"], action, *(state[c] for c in out)))
            yield pd.DataFrame(found, columns=[c.split()[0] for c in schema.split(", ")])

    ordered = incoming.select(*given).repartition(*keys).sortWithinPartitions(*keys, *columns[2:])
    return ordered.mapInPandas(fold, schema)


def review_queue(states: DataFrame, top: int) -> DataFrame:
    """Values to look at. The conflict is ordered by its name, downwards: resolved, pending, none; then the latest first."""
    return states.where("status <> 'verified' or conflict = 'pending'").orderBy(F.desc("conflict"), F.desc("updated_at"), "value_id").limit(top)
