"""A corpus pipeline of five stages: each takes the documents its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, langid, line_dedup, mixing, simhash
from lodestone.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages; ``lang`` becomes the language found.

    Null, empty and wordless texts have no language and go. A null or unknown ``lang`` declares nothing, a null ``source`` is a source of
    its own. Repeated rows are judged alike and stay. An empty table gives an empty table. As in every stage, the columns of
    documents come out and further ones, whatever their names, do not.
    """
    judged = langid.identify(docs.select(*COLUMNS), langid.fit(docs), declared=F.col("lang"), host=F.col("source"))
    return judged.where("lang_keep").withColumn("lang", F.col("lang_id")).select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more have stay in the last of them only; ``n_chars`` follows the text.

    Null text is empty; a text may become empty, and its document stays. Rows with one id count as one document, and all null ids as
    one that is never the last. Repeated rows stay. An empty table gives an empty table.
    """
    cleaned = line_dedup.line_dedup(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id (null ids last; of one id, the text with the least hash).

    Texts without words, null ones too, are one group. Of repeated rows one stays. An empty table gives an empty table.
    """
    return simhash.near_dedup(docs.select(*COLUMNS)).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate, in the mixture's order.

    A null source is a source. Repeated rows are drawn alike, by their id. An empty table gives an empty table.
    """
    return mixing.poisson_mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokenisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, checked by decoding them.

    Null and empty texts have no tokens. Repeated rows stay. An empty table gives an empty table.
    """
    coded = bpe.decode(bpe.encode(docs.select(*COLUMNS)))
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [("language_id", language_id), ("line_dedup", line_deduplication), ("simhash_near_dedup", near_deduplication), ("source_mixing", source_mixing), ("bpe", tokenisation)]

#: Language identification and SimHash groups are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written to the shared folder and read back, so that a lost executor costs one stage at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
