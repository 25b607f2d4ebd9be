"""Specification sheets: values as people read them, grouped into sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shown(boolean: Column, number: Column, text: Column, items: Column, unit: Column, raw: Column) -> Column:
    """A value of any kind: Sí or No, a number with its unit (inches right after it), the text, a list, else as it came."""
    whole = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(F.regexp_replace(number.cast("decimal(18,6)").cast("string"), "0+$", ""))
    with_unit = F.when(unit == '"', F.concat(whole, F.lit('"'))).when(F.length(unit) > 0, F.concat_ws(" ", whole, unit)).otherwise(whole)
    return F.coalesce(F.when(boolean, "Sí").when(~boolean, "No"), with_unit, F.when(F.length(text) > 0, text), F.when(F.size(items) > 0, F.array_join(items, ", ")), raw, F.lit(""))


def sheets(products: DataFrame, values: DataFrame) -> DataFrame:
    """A product's sections: first what it is, then the groups of its values by (group, sort_order, label); blanks are left out.

    values: product_id, group, sort_order, label, value. A product's own values are one row's worth of data.
    """
    general = F.filter(F.array(*[F.struct(F.lit(label).alias("label"), F.col(c).cast("string").alias("value")) for label, c in (("Marca", "brand"), ("Categoría", "category"))]), lambda x: F.length(x["value"]) > 0)
    item = F.struct("sort_order", "label", "value")
    groups = values.where("length(value) > 0").groupBy("product_id", "group").agg(F.array_sort(F.collect_list(item)).alias("items"))
    sections = groups.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("group", "items"))).alias("groups"))
    met = products.join(sections, F.col("id") == F.col("product_id"), "left")
    return met.select("id", general.alias("general"), F.coalesce("groups", F.array().cast(sections.schema["groups"].dataType)).alias("groups"))


def flattened(sections: Column) -> Column:
    """Label -> value over all sections; a later label replaces an earlier one."""
    items = F.flatten(F.transform(sections, lambda s: s["items"]))
    put = lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, _: k != x["label"]), F.create_map(x["label"], x["value"]))
    return F.aggregate(items, F.create_map().cast("map<string,string>"), put)


def advantages(values: DataFrame) -> DataFrame:
    """Per key the one product with the strictly greatest number, from (key, product_id, number)."""
    per = values.groupBy("key").agg(F.max(F.struct("number", "product_id")).alias("best"), F.count(F.lit(1)).alias("n"))
    ties = values.join(per.select("key", F.col("best.number").alias("top")), "key").where("number = top").groupBy("key").agg(F.count(F.lit(1)).alias("ties"))
    return per.join(ties, "key").where("ties = 1 and n > 1").select("key", "best.product_id", "best.number")
