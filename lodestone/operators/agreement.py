"""Whether texts from several sources agree on a claim: within units, and for the variant of a product that is meant."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import quantities, unmarked
from lodestone.tables import written

# Words that tell one variant of a product from another.
VARIANT_WORDS = (
    "pro", "promax", "plus", "mini", "max", "ultra", "super", "fe", "lite", "se",
    "ti", "evo", "xt", "b", "c", "e", "s", "slim", "elite", "gaming", "oc",
)


def words(col: Column) -> Column:
    """The different words of letters a-z and digits, without case and marks."""
    return F.array_distinct(F.regexp_extract_all(unmarked(F.coalesce(col, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def plain(col: Column) -> Column:
    """Without case and marks, with single spaces."""
    return F.trim(F.regexp_replace(unmarked(F.coalesce(col, F.lit(""))), r"\s+", " "))


def same_variant(model: Column, text: Column) -> Column:
    """Whether a text (words) tells of just this model (words): it has all its words, and no further word of VARIANT_WORDS."""
    markers = F.array(*map(F.lit, VARIANT_WORDS))
    return (F.size(model) > 0) & (F.size(F.array_except(model, text)) == 0) & ~F.arrays_overlap(F.array_except(text, model), markers)


def equivalent(a: Column, b: Column) -> Column:
    """Whether two texts say the same: the same numbers and the same units, if both have some; else the same words. Empty ones say nothing."""
    p, q = quantities(a), quantities(b)
    of = lambda c, field: F.array_sort(F.array_distinct(F.transform(c, lambda x: x[field])))
    numbers = (of(p, "value") == of(q, "value")) & (of(p, "unit") == of(q, "unit"))
    text = (plain(a) == plain(b)) & (F.length(F.coalesce(a, F.lit(""))) > 0)
    return F.coalesce(F.when((F.size(p) > 0) & (F.size(q) > 0), numbers).otherwise(text), F.lit(False))


def conflicting_claims(items: DataFrame) -> DataFrame:
    """The claims (claim) two of whose items (claim, said: an array of value and unit) share a unit and no value of it.

    Items become different lists of values by claim and unit, counted. A value that all lists hold settles a unit: no conflict. Without one, a
    list of a single value conflicts with some other list. What is left are units whose lists all have several values
    and none in common; each list is held against the shortest one, and only where all meet that, against the others.
    """
    units = lambda c: F.array_distinct(F.transform(c, lambda x: x["unit"]))
    values = lambda c, u: F.array_sort(F.array_distinct(F.transform(F.filter(c, lambda x: x["unit"] == u), lambda x: x["value"])))
    by_unit = items.select("claim", F.explode(F.transform(units(F.col("said")), lambda u: F.struct(u.alias("unit"), values(F.col("said"), u).alias("list")))).alias("x"))
    lists = written(by_unit.select("claim", "x.unit", "x.list").distinct(), "lists")
    key = ["claim", "unit"]
    sizes = lists.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.size("list").alias("size"), "list")).alias("short"))
    common = lists.select(*key, F.explode("list").alias("value")).groupBy(*key, "value").count().groupBy(*key).agg(F.max("count").alias("common"))
    open_ = sizes.where("n > 1").join(common, key).where("common < n")
    single = open_.where("short.size = 1").select("claim")
    several = lists.join(open_.where("short.size > 1").select(*key, F.col("short.list").alias("short")), key)
    apart = several.where(~F.arrays_overlap("list", "short")).select("claim")
    settled = single.unionByName(apart).distinct()
    rest = several.join(settled, "claim", "left_anti").select(*key, "list")
    other = rest.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("list").alias("_list"))
    met = (F.col("claim") == F.col("_claim")) & (F.col("unit") == F.col("_unit")) & ~F.arrays_overlap("list", "_list")
    return settled.unionByName(rest.join(other, met, "left_semi").select("claim")).distinct()


def classified(evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """One row for each claim of ``claims`` (claim, model) from the items of ``evidence`` (claim, title, content, confidence).

    claim, items (those that count), mismatched (those about another variant), verdict and confidence. With a model, an item that has none of its
    words does not count, and one about another variant is mismatched; without one (null or empty) all count. Verdicts:

    * variant_mismatch: items are mismatched and none counts.
    * conflict: two items share a unit and no value of it (confidence 0).
    * agreement: some item has a number with a unit: the greatest confidence, and 0.15 for each further item with one, at most 0.95;
      or no item has, and all that say something say the same: at most 0.9.
    * insufficient_evidence: no item counts, or they say different things without numbers (0).

    Null titles, contents and confidences are empty and 0. A claim that stands twice in ``claims`` with one model has one row;
    items of other claims are left out. Items of a claim with one text are counted before anything is read from it, and a text of several claims is read once.
    """
    wanted = claims.select("claim", F.coalesce("model", F.lit("")).alias("model")).distinct()
    text = F.concat_ws(" ", *[F.when(F.length(c) > 0, F.col(c)) for c in ("title", "content")])
    said = evidence.select("claim", text.alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("sure"))
    items = written(said.groupBy("claim", "text").agg(F.count(F.lit(1)).alias("n"), F.max("sure").alias("sure")), "items")
    read = items.select("text").distinct().withColumn("plain", plain(F.col("text")))
    digest = F.when(F.length("plain") > 0, F.sha2("plain", 256)).alias("digest")
    read = written(read.select("text", words(F.col("plain")).alias("words"), quantities(F.col("plain")).alias("said"), digest), "read")
    met = items.join(read, "text").join(wanted.withColumn("own", words(F.col("model"))), "claim")
    own, said, counts = F.col("own"), F.col("words"), F.col("kind") == "counts"
    kind = F.when(F.length("model") == 0, "counts").when(F.arrays_overlap(own, said), F.when(same_variant(own, said), "counts").otherwise("mismatched"))
    # Claims are told apart by model as well from here on.
    known = written(met.select(F.struct("claim", "model").alias("claim"), "n", "sure", kind.alias("kind"), "said", "digest"), "evidence").where("kind is not null")
    digest, total = F.when(counts, F.col("digest")), lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    per = known.groupBy("claim").agg(
        total(counts).alias("items"), total(~counts).alias("mismatched"), total(counts & (F.size("said") > 0)).alias("numeric"),
        F.max(F.when(counts, F.col("sure"))).alias("base"), F.min(digest).alias("_first"), F.max(digest).alias("_last"),
    )
    clash = conflicting_claims(known.where("kind = 'counts' and size(said) > 0").select("claim", "said")).withColumn("clash", F.lit(True))
    all_ = wanted.select(F.struct("claim", "model").alias("claim")).join(per, "claim", "left").join(clash, "claim", "left")
    rules = (
        (F.coalesce("items", F.lit(0)) == 0, F.when(F.col("mismatched") > 0, "variant_mismatch").otherwise("insufficient_evidence"), F.lit(0.0)),
        (F.col("clash"), F.lit("conflict"), F.lit(0.0)),
        (F.col("numeric") > 0, F.lit("agreement"), F.least(F.lit(0.95), F.col("base") + 0.15 * (F.col("numeric") - 1))),
        (F.col("_first") == F.col("_last"), F.lit("agreement"), F.least(F.lit(0.9), F.col("base"))),
    )
    choose = lambda i, last: reduce(lambda rest, rule: F.when(rule[0], rule[i]).otherwise(rest), reversed(rules), last)
    none = F.lit(0).cast("bigint")
    return all_.select(
        "claim.claim", "claim.model", F.coalesce("items", none).alias("items"), F.coalesce("mismatched", none).alias("mismatched"),
        choose(1, F.lit("insufficient_evidence")).alias("verdict"), F.round(choose(2, F.lit(0.0)), 2).alias("confidence"),
    )
