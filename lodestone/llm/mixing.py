"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Each source gets a mean repetition rate, ``rate = total * share / rows``. Each
document draws its number of copies from a Poisson distribution with that mean,
by inverting its distribution function at a number hashed from the seed and the
document's id. The draw depends on nothing else, so it is the same after a
lost executor, in another partitioning, and for a document that arrives later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import without, written

#: A rate above this is drawn as a sum of several draws, so that exp(-rate) stays well away from zero.
PART_RATE = 16.0
#: Terms of the distribution function; beyond these the tail of PART_RATE is under 2**-53.
TERMS = 80


def source_rates(docs: DataFrame, weights: DataFrame | None = None, *, power: float = 0.5, total: int | None = None, source_col: str = "source") -> DataFrame:
    """One row per source: ``source, n_rows, weight, rate``.

    ``weights`` has columns (source, weight); sources it lacks get weight 0 and
    leave the mixture. Without it, a source weighs ``n_rows ** power``. ``total``
    is the expected size of the mixture, by default the size of the input.
    A null source is a source of its own.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n_rows").cast("double"), F.lit(float(power))))
    else:
        given = weights.groupBy(F.col("source").alias("_of")).agg(F.sum("weight").cast("double").alias("weight"))
        weighed = counts.join(given, F.col("source").eqNullSafe(F.col("_of")), "left").select("source", "n_rows", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sums = weighed.agg(F.sum("weight").alias("w"), F.sum("n_rows").alias("n"))
    all_weight = sums.select("w").scalar()
    all_rows = F.lit(float(total)) if total is not None else sums.select(F.col("n").cast("double")).scalar()
    rate = F.when(F.col("weight") > 0, all_rows * (F.col("weight") / all_weight) / F.col("n_rows")).otherwise(0.0)
    return weighed.withColumn("rate", rate)


def _uniform(seed: int, *parts) -> F.Column:
    """A number in [0, 1) of 52 hashed bits."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def _distribution(rate: F.Column) -> F.Column:
    """[P(X <= 0), P(X <= 1), ...] of a Poisson variable."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(acc, j):
        p = acc["p"] * rate / j
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.array_append(acc["all"], c).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)).cast("array<double>"), start, step, lambda acc: acc["all"])


def poisson_mix(docs: DataFrame, weights: DataFrame | None = None, *, power: float = 0.5, total: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Replicate every document by its Poisson count and shuffle the mixture globally.

    Returns the input's columns plus ``copy`` (int, from 1) and ``mix_key``
    (string): the mixture's global order is that of mix_key, rows are dealt to
    partitions by its hash and sorted by it inside them. Input columns of these
    names give way. Rows that share an id draw the same count. A null id draws
    as the empty string does; a null source is a source of its own; null or
    long texts pass unchanged; an empty table gives an empty table.
    """
    docs = without(docs, "copy", "mix_key")
    rates = source_rates(docs, weights, power=power, total=total, source_col=source_col).where("rate > 0")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE).cast("int"))
    rates = rates.select(F.col("source").alias("_mix_source"), parts.alias("_mix_parts"), (F.col("rate") / parts).alias("_mix_rate"))
    rates = rates.select("_mix_source", "_mix_parts", _distribution(F.col("_mix_rate")).alias("_mix_cdf"))
    # Written, so that the planner knows its size: it broadcasts a small table, and joins a large one by source, where adaptive execution splits a hot source.
    rates = written(rates, "mixing-rates")
    joined = docs.join(rates, F.col(source_col).eqNullSafe(F.col("_mix_source")))
    draw = lambda i: F.size(F.filter("_mix_cdf", lambda c: c <= _uniform(seed, F.col(id_col), i)))
    count = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("_mix_parts")), draw), F.lit(0), lambda a, b: a + b)
    counted = joined.withColumn("_mix_n", count).where("_mix_n > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_mix_n"))))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}:order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("copy")))
    out = copies.drop("_mix_source", "_mix_parts", "_mix_cdf", "_mix_n").withColumn("mix_key", key)
    return out.repartition("mix_key").sortWithinPartitions("mix_key")


#: Over the documents table with the default parameters of poisson_mix().
ORACLE_SQL = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n_rows FROM documents GROUP BY source),
sums AS (SELECT sum(pow(n_rows::DOUBLE, 0.5)) AS w, sum(n_rows)::DOUBLE AS n FROM counts),
rates AS (SELECT source, n * (pow(n_rows::DOUBLE, 0.5) / w) / n_rows AS rate FROM counts, sums),
parts AS (SELECT source, greatest(1, ceil(rate / 16.0))::INTEGER AS parts, rate / greatest(1, ceil(rate / 16.0)) AS rate FROM rates),
terms AS (
  SELECT source, rate, 0 AS j, exp(-rate) AS p, exp(-rate) AS c FROM parts
  UNION ALL SELECT source, rate, j + 1, p * rate / (j + 1), c + p * rate / (j + 1) FROM terms WHERE j < 80),
drawn AS (
  SELECT d.doc_id, i.i, d.source, ('0x' || substr(md5('17|' || d.doc_id || '|' || i.i), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents d JOIN parts p ON d.source = p.source, LATERAL (SELECT unnest(range(1, p.parts + 1)) AS i) i),
sized AS (SELECT doc_id, sum(k)::INTEGER AS k FROM (
  SELECT r.doc_id, r.i, count(*) FILTER (WHERE t.c <= r.u) AS k FROM drawn r JOIN terms t ON t.source = r.source GROUP BY r.doc_id, r.i) GROUP BY doc_id),
copies AS (SELECT doc_id, unnest(range(1, k + 1))::INTEGER AS copy FROM sized)
SELECT d.*, c.copy, md5('17:order|' || d.doc_id || '|' || c.copy) AS mix_key FROM copies c JOIN documents d ON d.doc_id = c.doc_id
"""
