"""The registered queries of the corpus operators, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.urls import page_text
from lodestone.llm import additive, audio, bisectors, bpe, dual_tree, langid, line_dedup, mixing, norm_search, paragraphs, pii, prefix_free, simhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(col) -> F.Column:
    return F.sha2(col, 256)


def op1_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = paragraphs.paragraph_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_paragraphs", "n_removed", "n_passages", "class_ids", "spans", _sha("kept").alias("kept_sha256"))


def op2_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return additive.search(vectors, F.col("vec_id") % 20 == 0, k=20)


def op3_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _joined(spans) -> F.Column:
    """kind:start:end by start, then kind."""
    ordered = F.expr(f"array_sort(transform({spans}, x -> struct(x.start AS start, array_position(array('email', 'ip', 'card', 'phone'), x.kind) AS place, x.end AS end, x.kind AS kind)))")
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op4_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal(docs, pii.fit(docs))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) AS bigint) AS n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, _sha(_joined("base")).alias("base_sha256"), _joined("concat(base, added)").alias("spans"))


def op5_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    judged = langid.identify(docs, langid.fit(docs), declared=F.col("lang"), host=F.col("source"))
    return judged.select("doc_id", "lang", "source", "lang_id", "lang_confidence", "lang_keep")


def language_fusion_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four kinds of evidence over whole pages: their text, the declaration in the markup, the address suffix and the host. The models are fitted on documents."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html").withColumn("text", page_text(F.col("html")))
    judged = langid.identify(pages, langid.fit(_table(spark, sf_dir, "documents")), declared=langid.declared_in(F.col("html")), host=langid.host_of(F.col("url")))
    return judged.select("page_id", "url", "lang_id", "lang_confidence", "lang_keep")


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(_table(spark, sf_dir, "documents"))


def op7_line_cuckoo(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", _sha("text").alias("kept_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs).select("doc_id", "ids"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha(F.array_join("ids", " ")).alias("ids_sha256"), _sha("decoded").alias("decoded_sha256"))


def op9_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = prefix_free.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), _sha("kept").alias("kept_sha256"))


def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard = audio.audio_features(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    tail = F.expr("crc32(substring(payload, -64, 64))").alias("tail_crc32")
    return heard.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), _sha("payload").alias("payload_sha256"), tail, F.octet_length("media").cast("long").alias("media_bytes"), _sha("media").alias("media_sha256"), "feature")


def op11_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return norm_search.search(vectors, F.col("vec_id") % 50 == 0, k=5)


def op12_bisector_tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisectors.reported(bisectors.cluster(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def op13_dual_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.reported(dual_tree.compress(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_paragraph_minhash, op2_additive_quantisation, op3_simhash_bktree, op4_pii_skip_chain, op5_language_fusion, op6_poisson_mix,
        op7_line_cuckoo, op8_bpe, op9_prefix_free_parsing, op10_audio_features, op11_norm_buckets, op12_bisector_tournament,
        op13_dual_tree_codes, language_fusion_pages,
    )
}

ORACLES = {"op6_poisson_mix": mixing.ORACLE_SQL, "op7_line_cuckoo": line_dedup.ORACLE_SQL}
