"""Browsing by category: which category a term means, search below it, and facets over what was found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import SYNONYMS, fold, folded
from lodestone.operators.catalog import ancestors, search


def _may_mean(fragment: Column, term: str) -> Column:
    """Whether a term is a form of the word in the column, or in a commercial group with one of its forms."""
    short, stem = F.length(fragment) <= 3, fragment.endswith("s")
    cut = lambda n: F.substring(fragment, F.lit(1), F.length(fragment) - n)
    plural = F.when(fragment.endswith("es"), F.array(fragment, cut(1), cut(2))).when(stem, F.array(fragment, cut(1))).otherwise(F.array(fragment, F.concat(fragment, F.lit("s")), F.concat(fragment, F.lit("es"))))
    forms = F.when(short, F.array(fragment)).otherwise(plural)
    groups = [F.arrays_overlap(forms, F.array(*map(F.lit, group))) for group in SYNONYMS if fold(term) in group]
    return reduce(Column.__or__, groups, F.array_contains(forms, fold(term)))


def category_of(tree: DataFrame, term: str) -> DataFrame:
    """The category (at most one row of the tree: id, slug, name) that a term means: its slug, else its name, else a name or slug in which a word means the same; the smallest id of the best kind."""
    said = term.strip()
    flat = lambda c: F.trim(F.replace(folded(c), F.lit("-"), F.lit(" ")))
    words = F.array_distinct(F.flatten(F.array(*[F.concat(F.array(flat(c)), F.split(flat(c), r"\s+")) for c in ("slug", "name")])))
    alike = F.exists(F.filter(words, lambda w: w != ""), lambda w: _may_mean(w, said))
    kind = F.when(F.col("slug") == said, 0).when(F.col("name") == said, 1).when(alike & F.lit(said != ""), 2)
    return tree.withColumn("_kind", kind).where("_kind is not null").orderBy("_kind", "id").limit(1).drop("_kind")


def below(tree: DataFrame, term: str) -> DataFrame:
    """The ids of the category that a term means and of all below it; none for a term that means nothing."""
    meant = category_of(tree, term).select(F.col("id").alias("_root"))
    return ancestors(tree).join(meant, F.col("ancestor_id") == F.col("_root"), "left_semi").select("id").distinct()


def search_below(products: DataFrame, offers: DataFrame, tree: DataFrame, term: str, **conditions) -> DataFrame:
    """``search`` among the products (with a category_id) below the category that a term means."""
    within = below(tree, term).select(F.col("id").alias("_c"))
    return search(products.join(within, F.col("category_id") == F.col("_c"), "left_semi"), offers, **conditions)


def facets(products: DataFrame, spec_values: DataFrame, definitions: DataFrame, *, merge_keys: bool = False, top: int = 15) -> DataFrame:
    """Options and ranges of the specifications of a set of products (id): key, kind, value (null for a range), products, low, high, rank.

    definitions: definition_id, key, kind (text or number), sort_order; spec_values: definition_id, product_id, value_text, value_number.
    Of definitions with one key the first by (sort_order, definition_id) counts, and values of the others are left out, unless ``merge_keys``
    joins them under the first. Keys without a value in the set are left out.
    """
    order = Window.partitionBy("key").orderBy("sort_order", "definition_id")
    ranked = definitions.withColumn("_n", F.row_number().over(order)).withColumn("kind", F.first("kind").over(order))
    wanted = (ranked if merge_keys else ranked.where("_n = 1")).select("definition_id", "key", "kind")
    own = spec_values.join(wanted, "definition_id").join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    texts = own.where("kind = 'text' and value_text is not null").groupBy("key", F.col("value_text").alias("value")).agg(F.count_distinct("product_id").alias("products"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("products"), "value"))
    options = texts.withColumn("rank", rank).where(F.col("rank") <= top)
    none = lambda kind: F.lit(None).cast(kind)
    ranges = own.where("kind = 'number' and value_number is not null").groupBy("key").agg(F.count_distinct("product_id").alias("products"), F.min("value_number").alias("low"), F.max("value_number").alias("high"))
    left = options.select("key", F.lit("options").alias("kind"), "value", "products", none("double").alias("low"), none("double").alias("high"), "rank")
    return left.unionByName(ranges.select("key", F.lit("range").alias("kind"), none("string").alias("value"), "products", "low", "high", none("int").alias("rank")))


def listed(tree: DataFrame) -> DataFrame:
    """Categories in the order in which they are shown."""
    return tree.orderBy("sort_order", "name", "id")


