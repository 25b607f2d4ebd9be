"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior: the text under byte-trigram
models, the language that the markup (or the table) declares, the address
suffix, and the host. The priors of hosts are smoothed towards those of their
suffix, and these towards those of the whole corpus; all are grouped sums of
the posteriors that the text alone gives, so each row counts and no host is held in memory.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import text_or_empty, without, written

LANGUAGES = ("de", "en", "es", "fr")
#: Documents that the trigram models are fitted on, give or take a few roots of that: those of the labelled ones whose id and text have the least hashes.
SAMPLE = 4000
BINS = 1 << 16
#: How often a declaration is right; how many rows the parent's prior counts as; the prior of no language; the confidence that a document needs.
DECLARED, PARENT, NONE, LEAST = 0.9, 50.0, 1e-4, 0.5
#: Bytes whose trigrams are looked up at a time.
BLOCK = 1 << 22


def _bins(raw: np.ndarray) -> np.ndarray:
    """The bin of the trigram at each byte but the last two; A-Z count as a-z."""
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint32)
    return ((low[:-2] * np.uint32(0x9E3779B1)) ^ (low[1:-1] * np.uint32(0x85EBCA77)) ^ (low[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(16)


def _blocks(raw: np.ndarray):
    for at in range(0, max(0, len(raw) - 2), BLOCK):
        yield _bins(raw[at : at + BLOCK + 2])


def fit(docs: DataFrame, *, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", languages: tuple[str, ...] = LANGUAGES, sample: int = SAMPLE) -> np.ndarray:
    """Log-probabilities (languages x BINS) of trigrams, from a bounded sample of the labelled rows. The sample follows from the rows alone, not from how they are dealt to tasks."""
    key, share = F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 40)), min(1.0, sample / max(1, docs.count()))
    rows = docs.where((key < int((1 << 40) * share)) & F.col(label_col).isin(*languages) & F.col(text_col).isNotNull()).select(F.col(label_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                for bins in _blocks(np.frombuffer(text.encode(), np.uint8)):
                    sums[lang] = sums.get(lang, 0) + np.bincount(bins, minlength=BINS)
        for lang, row in sums.items():
            at = np.flatnonzero(row)
            yield type(pdf)({"lang": lang, "bin": at.astype(np.int32), "n": row[at].astype(np.int64)})

    sums = rows.mapInPandas(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    counts = np.full((len(languages), BINS), 0.05)
    for r in sums.toLocalIterator():  # at most languages x BINS rows
        counts[languages.index(r["lang"]), r["bin"]] += r["n"]
    return np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def _text_evidence(docs: DataFrame, model: np.ndarray, text_col: str) -> DataFrame:
    """Adds ``_lang_ll``: the tempered log-likelihoods of the text, one for each language and one for none."""
    schema = T.StructType([*docs.schema, T.StructField("_lang_ll", T.ArrayType(T.DoubleType(), False), False)])
    table = np.vstack([model, np.full((1, BINS), -math.log(BINS), np.float32)])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            out = np.zeros((len(texts), len(table)))
            for i, x in enumerate(texts):
                raw = np.frombuffer(x.as_py() or b"", np.uint8)
                for bins in _blocks(raw):
                    for j, row in enumerate(table[:-1]):
                        out[i, j] += row[bins].sum(dtype=np.float64)
                    out[i, -1] += table[-1, 0] * len(bins)
                # Neighbouring trigrams overlap: the evidence grows with the root of the length.
                out[i] /= math.sqrt(max(1, len(raw) - 2))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, len(table)), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "_lang_ll"])

    return docs.mapInArrow(run, schema)


def _softmax(logs: Column) -> Column:
    powers = F.transform(logs, lambda v: F.exp(v - F.array_max(logs)))
    return F.transform(powers, lambda v: v / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def _sums(df: DataFrame, n: int, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(n)]).alias("sums"), F.sum(F.lit(1.0)).alias("n"))


def priors(evidence: DataFrame, n: int) -> DataFrame:
    """(host, suffix, _lang_ll) rows -> (host, suffix, prior): three levels of grouped sums, each smoothed by the one above."""
    flat = F.transform("_lang_ll", lambda v: v)
    hosts = written(_sums(evidence.withColumn("p", _softmax(flat)), n, "host", "suffix"), "langid-hosts")
    level = lambda keys: hosts.groupBy(*keys).agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(n)]).alias("s"), F.sum("n").alias("m"))
    total = level([]).select(F.transform("s", lambda v: (v + 1.0) / (F.col("m") + float(n))).alias("top"))
    smooth = lambda sums, m, above: F.zip_with(sums, above, lambda s, a: (s + PARENT * a) / (m + PARENT))
    suffixes = level(["suffix"]).withColumn("top", total.scalar()).withColumn("mid", smooth(F.col("s"), F.col("m"), F.col("top"))).select(F.col("suffix").alias("_sfx"), "mid")
    return hosts.join(suffixes, F.col("suffix").eqNullSafe(F.col("_sfx"))).select("host", "suffix", smooth(F.col("sums"), F.col("n"), F.col("mid")).alias("prior"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def suffix_of(host: Column) -> Column:
    """The last label of a host that has several."""
    return F.lower(F.regexp_extract(F.coalesce(host, F.lit("")), r"\.([A-Za-z0-9-]+)\.?$", 1))


def declared_in(html: Column) -> Column:
    """The language in the lang attribute of the html element, without its region."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))


def identify(docs: DataFrame, model: np.ndarray, *, text_col: str = "text", declared: Column | None = None, host: Column | None = None, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Adds ``lang_id`` (a language, or und), ``lang_confidence`` (its posterior) and ``lang_keep``.

    A document is kept if a language, not none of them, has a posterior of at least LEAST. Null or empty texts have no evidence
    of their own and are und and rejected. Of equal posteriors the language named first counts. Null or unknown declarations say nothing; null hosts are a host of
    their own. Columns of these names give way. Repeated rows are judged alike. An empty table gives an empty table.
    """
    docs = without(docs, "lang_id", "lang_confidence", "lang_keep")
    names, n = [*languages, "und"], len(languages) + 1
    said = F.lower(F.substring(F.coalesce(declared if declared is not None else F.lit(""), F.lit("")), 1, 2))
    where = F.coalesce(host if host is not None else F.lit(""), F.lit(""))
    marked = docs.withColumns({"_lang_said": said, "_lang_host": where, "_lang_text": text_or_empty(text_col)})
    scored = _text_evidence(marked, model, "_lang_text").drop("_lang_text")
    evidence = scored.select(F.col("_lang_host").alias("host"), suffix_of(F.col("_lang_host")).alias("suffix"), "_lang_ll")
    # Written, so that the planner knows its size: it broadcasts a small one and joins a large one by host, where adaptive execution splits a hot host.
    prior = written(priors(evidence, n).select(F.col("host").alias("_lang_of"), F.col("prior").alias("_lang_prior")), "langid-priors")
    declares = F.array(*[F.when(~F.col("_lang_said").isin(*languages), 0.0).when(F.col("_lang_said") == name, math.log(DECLARED)).otherwise(math.log((1 - DECLARED) / n)) for name in names])
    rare = F.array(*[F.lit(0.0)] * len(languages), F.lit(math.log(NONE)))
    logs = F.transform(F.arrays_zip(F.col("_lang_ll").alias("a"), F.col("_lang_prior").alias("b"), declares.alias("c"), rare.alias("d")), lambda z: z["a"] + F.log(z["b"]) + z["c"] + z["d"])
    met = scored.join(prior, F.col("_lang_host") == F.col("_lang_of")).withColumn("_lang_post", logs).withColumn("_lang_post", _softmax(F.col("_lang_post")))
    best = F.array_position("_lang_post", F.array_max("_lang_post"))
    wordless = F.length(F.btrim(text_or_empty(text_col), F.lit(" \t\n\x0b\f\r"))) == 0
    lang = F.when(wordless, "und").otherwise(F.element_at(F.array(*map(F.lit, names)), best.cast("int")))
    out = met.withColumns({"lang_id": lang, "lang_confidence": F.array_max("_lang_post")})
    out = out.withColumn("lang_keep", (F.col("lang_id") != "und") & (F.col("lang_confidence") >= LEAST))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "lang_id", "lang_confidence", "lang_keep")
