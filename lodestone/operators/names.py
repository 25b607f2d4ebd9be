"""Pairs of similar names, without comparing all names of a group with each other.

The measure is the share of characters in matching blocks (difflib's ratio). With M matched characters of names of n and m, the
ratio is 2 M / (n + m); a name loses at most two of its bigrams for each character that is not matched, and one for each of the
other's, so at least 3 M - n - m - 1 bigrams are common. That bound makes a prefix filter: of a name's bigrams, the rarest first,
so few are looked at that a partner must share some of them, as many as the rest cannot make up for. Names or
thresholds too small for bigrams use single characters, of which at least M are common.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two names; not symmetric."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"


def _letters(name: str) -> Column:
    """How often each of the letters a-z and digits stands in a name."""
    return F.array(*[F.length(name) - F.length(F.replace(F.col(name), F.lit(c), F.lit(""))) for c in _ALPHABET])


def _in_common(total: Column | float, least: float, size: int) -> Column:
    """How many grams two names of ``total`` characters must share to reach the least ratio."""
    share = 1.5 * least - 1 if size == 2 else 0.5 * least
    return F.ceil(F.lit(share) * total - (1 if size == 2 else 0) - 1e-9)


def _grams(names: DataFrame, size: int) -> DataFrame:
    """(group, name, n, gram, place): a name's grams with the count of their repeats, the group's rarest first."""
    starts = F.sequence(F.lit(1), F.length("name") - (size - 1))
    parts = names.where(F.length("name") >= size).withColumn("all", F.transform(starts, lambda i: F.substring("name", i, F.lit(size))))
    each = parts.select("group", "name", "n", F.explode("all").alias("g")).groupBy("group", "name", "n", "g").agg(F.count(F.lit(1)).alias("k"))
    own = each.select("group", "name", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("k").cast("int")), lambda i: F.concat_ws("#", "g", i))).alias("gram"))
    often = own.groupBy("group", "gram").agg(F.count(F.lit(1)).alias("often"))
    order = Window.partitionBy("group", "name").orderBy("often", "gram")
    return own.join(often, ["group", "gram"]).withColumn("place", F.row_number().over(order)).drop("often")


def possible_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(group, a, b): pairs of the names (group, name) of both sides that may reach the least ratio; none that does is missing.

    A pair is made only where both names share a gram of their prefixes, and stays if lengths, places and letters allow the ratio.
    """
    tidy = lambda df: df.select("group", "name").where("length(name) > 0").distinct().withColumn("n", F.length("name"))
    left, right = tidy(left), tidy(right)
    ratio = (2 - least) / least  # how many times as long a partner may be
    # From this length on, two names that reach the ratio share a bigram for certain.
    bigrams_from = next((n for n in range(2, 200) if (1.5 * least - 1) * n * (1 + 1 / ratio) - 1 >= 1), None) if least > 0.7 else None
    ways = []
    if bigrams_from is not None:
        long_enough = F.col("n") >= bigrams_from
        ways.append((left.where(long_enough), right.where(long_enough), 2, F.lit(True)))
        short = F.col("n") < bigrams_from * ratio
        ways.append((left.where(short), right.where(short), 1, F.least("n", "m") < bigrams_from))
    else:
        ways.append((left, right, 1, F.lit(True)))
    out = None
    for ls, rs, size, wanted in ways:
        both = _grams(ls.unionByName(rs).distinct(), size)
        count = F.col("n") - (size - 1)
        shortest = F.ceil(F.col("n") / ratio - 1e-9)  # of a partner
        prefix = both.where(F.col("place") <= count - F.greatest(_in_common(F.col("n") + shortest, least, size), F.lit(1)) + 1)
        side = lambda own, a, n, p: prefix.join(own.select("group", "name"), ["group", "name"], "left_semi").select("group", "gram", F.col("name").alias(a), F.col("n").alias(n), F.col("place").alias(p))  # noqa: E731, E501, B023
        met = side(ls, "a", "n", "p").join(side(rs, "b", "m", "q"), ["group", "gram"]).where(wanted)
        total = F.col("n") + F.col("m")
        met = met.where(2 * F.least("n", "m") >= least * total - 1e-9)
        # Of the common grams, those that are not in both prefixes are in the rest of the one whose prefix ends first.
        rest = lambda n: F.greatest(_in_common(F.col(n) + F.ceil(F.col(n) / ratio - 1e-9), least, size), F.lit(1)) - 1  # noqa: E731, B023
        shared = met.groupBy("group", "a", "b", "n", "m").agg(F.count(F.lit(1)).alias("k"))
        met = shared.withColumn("enough", F.col("k") + F.greatest(rest("n"), rest("m")) >= _in_common(total, least, size))
        out = met if out is None else out.unionByName(met)
    # Letters are counted only for pairs with enough grams in common: as a filter of its own, Spark would ask it of every pair that met.
    l, r = _letters("a"), _letters("b")  # noqa: E741
    total = lambda counts: F.aggregate(counts, F.lit(0), lambda x, y: x + y)
    others = F.least(F.col("n") - total(l), F.col("m") - total(r))
    common = total(F.zip_with(l, r, lambda x, y: F.least(x, y))) + others
    possible = F.when(F.col("enough"), 2 * common >= least * (F.col("n") + F.col("m")) - 1e-9).otherwise(False)
    return out.where(possible).select("group", "a", "b").distinct()


def similar_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(group, a, b, score): all pairs of names of a group with at least the ratio. Null groups and names have no pairs."""
    return possible_pairs(left, right, least).withColumn("score", name_ratio("a", "b")).where(F.col("score") >= least)
