"""Which terms of a dictionary stand in which texts, as substrings.

Two ways, by the dictionary's size. One within a bound of rows and characters goes to every task as an automaton that reads a
text once, whatever the number of terms. A larger one meets the texts in an equi-join on grams: a term that
stands in a text shares all its grams with it, so its rarest one is enough to find the pair, which is then looked at.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.batches import pieces

#: Terms and characters of a dictionary that every task may hold, and the length of a gram.
MOST_TERMS, MOST_CHARACTERS, GRAM = 50_000, 4_000_000, 4
#: Texts and characters that a task reads between two pieces of its output; and terms so short and few that they are looked for one by one.
AT_ONCE, CHARACTERS_AT_ONCE, SHORT, FEW = 256, 1_000_000, 3, 100


def _small(terms: DataFrame, most_terms: int, most_characters: int) -> list[str] | None:
    """The different terms, if they are within the bound: at most one row over it comes to the driver."""
    size = terms.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("c")).first()
    return [r["term"] for r in terms.collect()] if size["n"] <= most_terms and size["c"] <= most_characters else None


def held(
    texts: DataFrame, terms: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, most_terms: int = MOST_TERMS, most_characters: int = MOST_CHARACTERS
) -> DataFrame:
    """The rows of ``texts`` with each term of ``terms`` (term) that their text holds anywhere, inside words too: one row a pair.

    Texts and terms are compared as they are; a caller folds both first. Null texts hold nothing, empty and null terms are
    left out, repeated terms count once, repeated rows stay. A column ``term`` of the texts gives way. Of the columns of the texts only
    ``keep`` come with a pair, all by default: long texts are best left out.
    """
    wanted = terms.select("term").where("length(term) > 0").distinct()
    found = _small(wanted, most_terms, most_characters)
    rows = texts.drop("term") if text_col != "term" else texts
    rows = rows.select(*dict.fromkeys([*keep, text_col])) if keep is not None else rows
    kept = rows.columns if keep is None else keep
    return _by_automaton(rows, found, text_col, kept) if found is not None else _by_grams(rows, wanted, text_col).select(*kept, "term")


def _by_automaton(texts: DataFrame, terms: list[str], text_col: str, kept: list[str]) -> DataFrame:
    """Texts are read piece by piece, so that a task holds the pairs of a few of them alone."""
    schema = T.StructType([*[texts.schema[c] for c in kept], T.StructField("term", T.StringType())])
    at, own = texts.columns.index(text_col), [texts.columns.index(c) for c in kept]
    # Short terms stand at many places of a text; looking for the first one of each is cheaper than meeting all, while they are few.
    short = [t for t in terms if len(t) <= SHORT]
    short = short if len(short) <= FEW else []

    def run(batches):
        machine = ahocorasick.Automaton()
        for t in set(terms).difference(short):
            machine.add_word(t, t)
        machine.make_automaton()
        some = len(machine) > 0

        def hits(x: str | None) -> list[str]:
            return sorted({*[t for t in short if t in x], *([t for _, t in machine.iter(x)] if some else [])}) if x else []

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            for a, b in pieces(sizes, AT_ONCE, CHARACTERS_AT_ONCE):
                part = batch.slice(a, b - a)
                found = [hits(x) for x in part.column(at).to_pylist()]
                rows = pa.array([i for i, ts in enumerate(found) for _ in ts], pa.int32())
                if len(rows):
                    columns = [part.column(i).take(rows) for i in own] + [pa.array([t for ts in found for t in ts], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*kept, "term"])

    return texts.mapInArrow(run, schema)


def grams(col: Column, size: int) -> Column:
    """The different stretches of ``size`` characters of a text; none of a shorter one."""
    starts = F.when(F.length(col) >= size, F.sequence(F.lit(1), F.length(col) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(col, i, F.lit(size))))


def _by_grams(texts: DataFrame, terms: DataFrame, text_col: str, size: int = GRAM) -> DataFrame:
    """Terms shorter than a gram are their own gram, of their length."""
    own = terms.withColumn("g", F.explode(F.when(F.length("term") >= size, grams(F.col("term"), size)).otherwise(F.array("term"))))
    often = own.groupBy("g").agg(F.count(F.lit(1)).alias("often"))
    first = Window.partitionBy("term").orderBy("often", "g")
    keys = own.join(often, "g").withColumn("_n", F.row_number().over(first)).where("_n = 1").select("g", "term")
    lengths = sorted(r["n"] for r in terms.select(F.least(F.length("term"), F.lit(size)).alias("n")).distinct().collect())  # at most ``size``
    said = F.array_distinct(F.flatten(F.array(*[grams(F.col(text_col), n) for n in lengths]))) if lengths else F.array().cast("array<string>")
    met = texts.withColumn("g", F.explode(said)).join(keys, "g")
    return met.where(F.col(text_col).contains(F.col("term"))).select(*texts.columns, "term")


def absent(mentions: DataFrame, names: DataFrame, *, least: int = 3, **bounds: int) -> DataFrame:
    """Mentions (message_id, term) of at least ``least`` characters that neither hold a name or brand of the catalogue (name) nor stand in one,
    without case; one row for each term of a message."""
    low = F.lower(F.trim("term"))
    wanted = mentions.select("message_id", low.alias("term")).where(F.length("term") >= least).distinct()
    known = names.select(F.lower("name").alias("name")).where("length(name) > 0").distinct()
    inside = held(known, wanted, text_col="name", keep=[], **bounds)
    around = held(wanted.select(F.col("term").alias("said")).distinct(), known.select(F.col("name").alias("term")), text_col="said", **bounds)
    return wanted.join(inside.unionByName(around.select(F.col("said").alias("term"))).distinct(), "term", "left_anti").select("message_id", "term")
