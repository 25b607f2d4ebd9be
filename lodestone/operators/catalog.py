"""Catalogue search, facets, the category tree, and product cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import fold, matches_all, search_terms, synonyms
from lodestone.tables import written


def number_range(text: str) -> tuple[int, int] | None:
    """ "lo-hi" in whole numbers; None if it is no such range or upside down."""
    lo, _, hi = text.partition("-")
    try:
        return (int(lo), int(hi)) if int(lo) <= int(hi) else None
    except ValueError:
        return None


def subtree(tree: DataFrame, root_id: int) -> DataFrame:
    """The ids of a category and all below it, however deep; a cycle's members are below each other."""
    return ancestors(tree).where(F.col("ancestor_id") == root_id).select("id").distinct()


def ancestors(tree: DataFrame) -> DataFrame:
    """(id, ancestor_id): each category with itself and all above it."""
    return closure(tree).select("id", "ancestor_id")


def closure(tree: DataFrame) -> DataFrame:
    """(id, ancestor_id, distance): each category with itself and all above it, at the least distance, without a limit of levels.

    Pointer doubling: a round looks twice as far as the last, so a chain of a thousand takes ten. Cycles add no new pairs once they
    have been walked around, and the rounds end when a round adds none. Each pair is written to the shared folder once, in the round
    that finds it. A parent without a row of its own is above its children at every distance; nothing is above it.
    """
    ids = tree.select("id", F.col("id").alias("ancestor_id"), F.lit(0).alias("distance")).distinct()
    jump = tree.where("parent_id is not null").select("id", F.col("parent_id").alias("ancestor_id")).distinct()
    nearest = lambda pairs: pairs.groupBy("id", "ancestor_id").agg(F.min("distance").alias("distance"))
    reach, step = written(nearest(ids.unionByName(jump.withColumn("distance", F.lit(1)))), "closure"), 1
    while True:
        over = jump.select(F.col("id").alias("_from"), F.col("ancestor_id").alias("_over"))
        jump = written(jump.join(over, F.col("ancestor_id") == F.col("_from")).select("id", F.col("_over").alias("ancestor_id")).distinct(), "jumps")
        step *= 2
        far = jump.select(F.col("id").alias("_id"), F.col("ancestor_id").alias("_over"))
        # Where a jump lands counts by itself: a parent that has no row is nowhere in ``reach`` as an id.
        landed = far.select(F.col("_id").alias("id"), F.col("_over").alias("ancestor_id"), F.lit(step).alias("distance"))
        beyond = far.join(reach, F.col("_over") == F.col("id")).select(F.col("_id").alias("id"), "ancestor_id", (F.col("distance") + step).alias("distance"))
        known = reach.select(F.col("id").alias("_id"), F.col("ancestor_id").alias("_ancestor"))
        fresh = nearest(landed.unionByName(beyond)).join(known, F.col("id").eqNullSafe(F.col("_id")) & (F.col("ancestor_id") == F.col("_ancestor")), "left_anti")
        fresh = written(fresh, "closure")
        if fresh.isEmpty():
            return reach
        reach = reach.unionByName(fresh)


def closure_totals(tree: DataFrame) -> DataFrame:
    """(id, highest, distance, n): of each category's pairs in ``closure`` the smallest ancestor, the largest distance and their number.

    Where each category has one parent, all above it lie on one walk, whose smallest id and length pointer doubling carries along:
    a round holds a row of each category at most, and the pairs are never made. Walks into cycles are done over, up to their cycle.
    Where a category has several parents, ways may part and meet again, so the pairs are made and counted.
    """
    rows = written(tree.groupBy("id").agg(F.min("parent_id").alias("over"), F.max("parent_id").alias("_other")), "parents")
    if not rows.where("over <> _other").isEmpty():
        return closure(tree).groupBy("id").agg(F.min("ancestor_id").alias("highest"), F.max("distance").alias("distance"), F.count(F.lit(1)).alias("n"))
    start = rows.select("id", "over", F.col("id").alias("highest"), F.lit(1).cast("bigint").alias("n"))
    ended, endless = _walks(start)
    if not endless.isEmpty():
        again = start.join(endless.select(F.col("id").alias("_endless")), F.col("id").eqNullSafe(F.col("_endless")), "left_semi")
        ring = _rings(again.join(_places(endless), F.col("id") == F.col("_place"), "left_semi"))
        whole = ring.select(F.col("id").alias("_id"), F.col("highest").alias("_highest"), F.col("n").alias("_n"))
        again = again.join(whole, F.col("id") == F.col("_id"), "left").select(
            "id", F.when(F.col("_id").isNull(), F.col("over")).alias("over"), F.coalesce("_highest", "highest").alias("highest"), F.coalesce("_n", "n").alias("n")
        )
        ended = ended.unionByName(_walks(written(again, "walks"))[0])
    return ended.select("id", "highest", (F.col("n") - 1).cast("int").alias("distance"), "n")


def _walks(start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Walks that end, and those that run into a cycle, with a place behind each as ``over``. start: id, over, highest and n of those below over.

    A walk that ends, however long, passes categories that are each one level nearer to its end. So once twice as many levels end no
    further walk, none that is left will end.
    """
    ended, on = start.where("over is null"), start.where("over is not null")
    before, left = 0, on.count()
    while left and left != before:
        above = ended.unionByName(on).select(F.col("id").alias("_id"), F.col("over").alias("_over"), F.col("highest").alias("_highest"), F.col("n").alias("_n"))
        # A parent that has no row counts by itself.
        step = on.join(above, F.col("over") == F.col("_id"), "left").select(
            "id", F.col("_over").alias("over"), F.least("highest", F.coalesce("_highest", "over")).alias("highest"), (F.col("n") + F.coalesce("_n", F.lit(1))).alias("n")
        )
        step = written(step, "walks")
        ended, on = ended.unionByName(step.where("over is null")), step.where("over is not null")
        before, left = left, on.count()
    return ended, on


def _places(endless: DataFrame) -> DataFrame:
    """(_place): all members of cycles, from walks that run into one.

    The places reached after twice as many levels are among those reached before. Once they are no fewer, each of them is reached from
    one of them, so all are on cycles.
    """
    jump = endless.select("id", "over")
    before, n = 0, jump.agg(F.count_distinct("over")).first()[0]
    while n != before:
        above = jump.select(F.col("id").alias("_id"), F.col("over").alias("_over"))
        jump = written(jump.join(above, F.col("over") == F.col("_id")).select("id", F.col("_over").alias("over")), "jumps")
        before, n = n, jump.agg(F.count_distinct("over")).first()[0]
    return jump.select(F.col("over").alias("_place")).distinct()


def _rings(members: DataFrame) -> DataFrame:
    """(id, highest, n): each member of a cycle with the cycle's smallest id and length. members: id, over, highest (its own id).

    Once twice as many levels bring no member a smaller id, those levels have covered the cycle.
    """
    ring = written(members.select("id", "over", "highest"), "rings")
    while True:
        above = ring.select(F.col("id").alias("_id"), F.col("over").alias("_over"), F.col("highest").alias("_highest"))
        wider = ring.join(above, F.col("over") == F.col("_id")).select("id", F.col("_over").alias("over"), F.least("highest", "_highest").alias("highest"), (F.col("_highest") < F.col("highest")).alias("_less"))
        wider = written(wider, "rings")
        ring = wider.drop("_less")
        if wider.where("_less").isEmpty():
            break
    length = ring.groupBy(F.col("highest").alias("_highest")).agg(F.count(F.lit(1)).alias("n"))
    return ring.join(length, F.col("highest") == F.col("_highest")).select("id", "highest", "n")


def category_named(tree: DataFrame, term: str) -> DataFrame:
    """The categories a term may mean: by slug-like name, else by a synonym in the name; the smallest id of the best kind."""
    name = F.lower("name")
    exact = name == fold(term)
    like = reduce(Column.__or__, [name.contains(s) for s in sorted(synonyms(term))])
    kind = F.when(exact, 0).when(like, 1)
    return tree.withColumn("_kind", kind).where("_kind is not null").orderBy("_kind", "id").limit(1).drop("_kind")


def search(
    products: DataFrame, offers: DataFrame, *, query: str = "", brand: str = "", category: DataFrame | None = None, min_price: int | None = None, max_price: int | None = None,
    spec_values: DataFrame | None = None, options: dict[str, list[str]] | None = None, ranges: dict[str, str] | None = None, ids: str | None = None,
) -> DataFrame:
    """Products with an offer that meets all conditions: id, name, brand, category, sort_price (the least price among the offers met).

    Price bounds hold for the offer rows, whatever their availability or currency. ``category`` is a frame of category names.
    ``options`` and ``ranges`` are conditions on specification values, each a semi-join. ``ids`` is a comma-separated list; without a number in it nothing is found.
    """
    found = products
    if query:
        found = found.where(matches_all(search_terms(query), *[F.col(c) for c in ("name", "brand", "category")]))
    if brands := [b.strip() for b in brand.split(",") if b.strip()]:
        found = found.where(reduce(Column.__or__, [F.col("brand").ilike(b) for b in brands]))
    if category is not None:
        found = found.join(category.select(F.col("name").alias("_cat")), F.col("category") == F.col("_cat"), "left_semi")
    if ids is not None:
        found = found.where(F.col("id").isin([int(x) for x in ids.split(",") if x.strip().isdigit()]))
    for key, values in (options or {}).items():
        hit = spec_values.where((F.col("key") == key) & F.col("value_text").isin(values))
        found = found.join(hit.select(F.col("product_id").alias("_pid")), F.col("id") == F.col("_pid"), "left_semi")
    for key, text in (ranges or {}).items():
        if (bounds := number_range(text)) is not None:
            hit = spec_values.where((F.col("key") == key) & F.col("value_number").between(*bounds))
            found = found.join(hit.select(F.col("product_id").alias("_pid")), F.col("id") == F.col("_pid"), "left_semi")
    rows = offers
    if min_price is not None:
        rows = rows.where(F.col("price") >= min_price)
    if max_price is not None:
        rows = rows.where(F.col("price") <= max_price)
    # The offers shrink to a row for each product before they meet the products.
    least = rows.groupBy(F.col("product_id").alias("_pid")).agg(F.min("price").alias("sort_price"))
    return found.join(least, F.col("id") == F.col("_pid")).drop("_pid")


def paged(found: DataFrame, *, order: str = "price_asc", limit: int = 20, offset: int = 0) -> DataFrame:
    """One page. price_desc orders by the least price, too; the id breaks ties."""
    by = {"price_asc": [F.asc("sort_price")], "price_desc": [F.desc("sort_price")], "name": [F.asc("name")], "newest": [F.desc("id")], "ids": []}[order]
    return found.orderBy(*by, "id").offset(offset).limit(limit)


def facet_summary(products: DataFrame, offers: DataFrame) -> DataFrame:
    """total (products with offers), min_price and max_price over all their offers."""
    met = offers.join(products.select("id"), F.col("product_id") == F.col("id"))
    return met.agg(F.count_distinct("product_id").alias("total"), F.min("price").alias("min_price"), F.max("price").alias("max_price"))


def brand_facet(products: DataFrame, top: int = 20) -> DataFrame:
    """Products of each brand, with or without offers; the largest first."""
    return products.where("brand is not null").groupBy("brand").agg(F.count_distinct("id").alias("products")).orderBy(F.desc("products"), "brand").limit(top)


def option_facet(spec_values: DataFrame, definitions: DataFrame, top: int = 15) -> DataFrame:
    """The commonest texts of each textual specification, in one pass over all of them."""
    texts = spec_values.join(F.broadcast(definitions.where("kind = 'text'").select("key")), "key").where("value_text is not null")  # a fixed list of definitions
    counts = texts.groupBy("key", "value_text").agg(F.count_distinct("product_id").alias("products"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("products"), "value_text"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


def number_facet(spec_values: DataFrame, definitions: DataFrame) -> DataFrame:
    numbers = spec_values.join(F.broadcast(definitions.where("kind = 'number'").select("key")), "key")  # a fixed list of definitions
    return numbers.groupBy("key").agg(F.min("value_number").alias("low"), F.max("value_number").alias("high")).where("low is not null")


def tree_counts(tree: DataFrame, members: DataFrame) -> DataFrame:
    """Each category with its direct members and those of its whole subtree. members: category_id."""
    direct = members.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    spread = ancestors(tree).join(direct, F.col("id") == F.col("category_id"), "left")
    totals = spread.groupBy("ancestor_id").agg(F.coalesce(F.sum(F.when(F.col("id") == F.col("ancestor_id"), F.col("n"))), F.lit(0)).alias("products"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_products"))
    return tree.join(totals, F.col("id") == F.col("ancestor_id")).select("id", "parent_id", "name", "products", "total_products")


def repeated_names(tree: DataFrame) -> DataFrame:
    """Names that occur more than once under one parent."""
    return tree.groupBy("name", "parent_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def comparison(products: DataFrame, spec_values: DataFrame, ids: list[int]) -> DataFrame:
    """Specification key x product; a key that none of them has is absent."""
    value = F.coalesce(F.col("value_text"), F.col("value_number").cast("string"))
    rows = spec_values.where(F.col("product_id").isin(ids)).select("key", F.concat(F.lit("p"), F.col("product_id")).alias("col"), value.alias("value"))
    return rows.groupBy("key").pivot("col", [f"p{i}" for i in ids]).agg(F.first("value"))
