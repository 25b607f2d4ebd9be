"""Queries of pages, documents, chunks, vectors and their retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone import bindings as b
from lodestone.functions import text as t
from lodestone.functions import urls as u
from lodestone.functions.vectors import hash_rows, hash_sums, hash_vectors
from lodestone.operators import ingest
from lodestone.operators import retrieval as r
from lodestone.registry import query

_TRACK = "'" + "', '".join(u.TRACKING) + "'"
_NORMAL = (
    "n AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare FROM pages), m AS (SELECT page_id, url, lower(regexp_extract(bare, '^[A-Za-z]+://([^/:?#]*)', 1)) AS host, regexp_extract(bare, '^[A-Za-z]+://[^/?]*([^?]*)', 1) AS path, list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda x: regexp_matches(x, '^[^=]+=.') AND NOT list_contains([" + _TRACK + "], lower(regexp_extract(x, '^([^=]*)', 1)))) AS kept FROM n), "
    "normal AS (SELECT page_id, url, host, 'https://' || host || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS normal FROM m)"
)


@query(f"WITH {_NORMAL} SELECT page_id, normal FROM normal")
def url_normalize(spark, sf_dir):
    return b.table(spark, sf_dir, "pages").select("page_id", u.normal_url(F.col("url")).alias("normal"))


@query(f"WITH {_NORMAL} SELECT min(page_id) AS page_id, arg_min(url, page_id) AS url, normal, count(*) AS n FROM normal GROUP BY normal")
def url_dedup(spark, sf_dir):
    return ingest.first_by_url(b.table(spark, sf_dir, "pages").select("page_id", "url"))


_IN = lambda hosts: "bare IN ('" + "', '".join(hosts) + "')"


@query(f"WITH {_NORMAL}, b AS (SELECT page_id, host, regexp_replace(host, '^www\\.', '') AS bare FROM normal), k AS (SELECT page_id, host, CASE WHEN {_IN(u.MANUFACTURERS)} OR ends_with(bare, '.asus.com') THEN 'manufacturer' WHEN {_IN(u.BENCHMARKS)} THEN 'benchmark' WHEN {_IN(u.REVIEWS)} THEN 'review' ELSE 'web' END AS source_type FROM b) SELECT page_id, host, source_type, CASE source_type WHEN 'manufacturer' THEN 50 WHEN 'benchmark' THEN 40 WHEN 'review' THEN 30 ELSE 20 END AS priority, host <> '' AND NOT regexp_matches(host, '^(localhost|127\\.|10\\.|192\\.168\\.)') AS safe FROM k")
def source_type(spark, sf_dir):
    pages = b.table(spark, sf_dir, "pages").select("page_id", u.host(F.col("url")).alias("host"), u.source_type(F.col("url")).alias("source_type"), u.safe_to_fetch(F.col("url")).alias("safe"))
    return pages.withColumn("priority", u.source_priority(F.col("source_type")))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, regexp_extract(html, '(?i)<html[^>]* lang=\"([^\"]*)\"', 1) AS lang, len(regexp_extract_all(html, '(?i)<meta\\s')) AS n_meta FROM pages")
def html_title_meta(spark, sf_dir):
    return b.table(spark, sf_dir, "pages").select("page_id", u.page_title(F.col("html")).alias("title"), F.regexp_extract("html", '(?i)<html[^>]* lang="([^"]*)"', 1).alias("lang"), F.size(F.regexp_extract_all("html", F.lit(r"(?i)<meta\s"), F.lit(0))).cast("bigint").alias("n_meta"))


@query("WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS n FROM l GROUP BY ALL")
def html_links(spark, sf_dir):
    return b.table(spark, sf_dir, "pages").select("page_id", F.explode(u.links(F.col("html"))).alias("href")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS x FROM pages) "
    "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS text FROM a"
)
def html_to_text(spark, sf_dir):
    return b.table(spark, sf_dir, "pages").select("page_id", u.page_text(F.col("html")).alias("text"))


_CLEAN = "trim(regexp_replace(coalesce(text, ''), '[ \t\n\r]+', ' ', 'g'))"


@query(f"WITH h AS (SELECT doc_id, sha256({_CLEAN}) AS content_hash, greatest(1, round_even(length({_CLEAN}) / 4.0::DOUBLE, 0))::INTEGER AS approx_tokens FROM documents) SELECT min(doc_id) AS doc_id, content_hash, arg_min(approx_tokens, doc_id) AS approx_tokens, count(*) AS copies FROM h GROUP BY content_hash")
def doc_dedup(spark, sf_dir):
    return ingest.first_documents(b.table(spark, sf_dir, "documents"))


@query()
def doc_chunks(spark, sf_dir):
    """Chunks of 900 characters that overlap by 120; the tests hold the cuts against the rules."""
    docs = b.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(r.chunks("text", F.lit(900), F.lit(120))).alias("chunk_index", "content"))
    return docs.withColumn("approx_tokens", F.greatest(F.lit(1), F.bround(F.length("content") / 4.0).cast("int")))


_WORDS = ("the", "and", "thereou", "ing", "tion")
_HITS = lambda col: " + ".join(f"contains(lower({col}), '{w}')::INTEGER" for w in _WORDS)


def _as_chunks(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("title"), F.col("lang").alias("identity"))


@query(f"WITH s AS (SELECT doc_id AS chunk_id, text AS content, source AS title, lang AS identity, round(({_HITS('text')} + 0.5::DOUBLE * ({_HITS('source')}) + 0.75::DOUBLE * ({_HITS('lang')})) / 5.0::DOUBLE, 4) AS score FROM documents) SELECT * FROM s WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 40")
def keyword_topk(spark, sf_dir):
    return r.keyword_search(_as_chunks(spark, sf_dir), " ".join(_WORDS), 40)


_BUCKETS = (
    "{0}k AS (SELECT id, sha256(tok) AS h FROM {0}t), {0}m AS (SELECT id, ('0x' || substr(h, 15, 2))::INTEGER AS i, ('0x' || substr(h, 14, 1))::INTEGER % 2 * 2 - 1 AS s FROM {0}k), {0}b AS (SELECT id, i, sum(s)::DOUBLE AS v FROM {0}m GROUP BY ALL), "
    "{0}n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM {0}b GROUP BY 1), {0}v AS (SELECT b.id, i AS bucket, v / norm AS value FROM {0}b b JOIN {0}n n ON n.id = b.id WHERE v <> 0)"
)


@query("WITH dt AS (SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS tok FROM documents), " + _BUCKETS.format("d") + " SELECT id AS doc_id, bucket, round(value, 9) AS value FROM dv")
def hash_embedding(spark, sf_dir):
    words = b.table(spark, sf_dir, "documents").select("doc_id", F.explode(t.tokens(F.col("text"))).alias("token"))
    return hash_rows(words, "doc_id").withColumn("value", F.round("value", 9))


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


_NEAR = f"WITH q AS (SELECT vec_id AS query_id, label AS own, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.query_id, e.vec_id, {_COS} AS score FROM q JOIN embeddings e ON e.label = q.own), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s WHERE score >= 0.05) SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10"


@query(_NEAR)
def vector_topk(spark, sf_dir):
    """Every row whose id is divisible by 50 against all vectors of its own label: a filtered search."""
    rows = b.table(spark, sf_dir, "embeddings")
    return r.nearest(rows, F.col("vec_id") % 50 == 0, 10, 0.05, within="label").withColumn("score", F.round("score", 6))


@query(f"WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.query_id, e.vec_id, {_COS} AS score FROM q, embeddings e), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s WHERE score >= 0.05) SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10")
def vector_topk_all(spark, sf_dir):
    """Every row whose id is divisible by 50 against all vectors."""
    return r.nearest(b.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 10, 0.05).withColumn("score", F.round("score", 6))


_VOCAB = ("and", "the", "thought", "tion")
_DOC_TOKENS = "SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS tok FROM documents"
#: Sums of signs by bucket and their norms, for tokens {0}t.
_SUMS = (
    "{0}k AS (SELECT id, sha256(tok) AS h FROM {0}t), "
    "{0}m AS (SELECT id, ('0x' || substr(h, 15, 2))::INTEGER AS i, ('0x' || substr(h, 14, 1))::INTEGER % 2 * 2 - 1 AS s FROM {0}k), "
    "{0}b AS (SELECT id, i, sum(s)::DOUBLE AS v FROM {0}m GROUP BY ALL), {0}n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM {0}b GROUP BY 1)"
)
#: Cosines of the vectors of d and q.
_MEET = (
    "c AS (SELECT qb.id AS query_id, db.id AS doc_id, sum(db.v * qb.v) AS dot FROM db JOIN qb ON qb.i = db.i GROUP BY ALL), "
    "s AS (SELECT query_id, doc_id, dot / (dn.norm * qn.norm) AS score FROM c JOIN dn ON dn.id = doc_id JOIN qn ON qn.id = query_id WHERE dn.norm > 0 AND qn.norm > 0)"
)


def _hashed(spark, sf_dir, name, key):
    """The hash vectors of a table's texts."""
    return hash_vectors(b.table(spark, sf_dir, name).select(key, F.explode(t.tokens(F.col("text"))).alias("token")), key)


@query(
    f"WITH dt AS ({_DOC_TOKENS}), qt AS (SELECT 0 AS id, unnest({list(_VOCAB)}) AS tok), " + _SUMS.format("d") + ", " + _SUMS.format("q") + ", " + _MEET + ", "
    "w AS (SELECT doc_id, round((" + " + ".join(f"contains(lower(text), '{w}')::INTEGER" for w in _VOCAB) + " + 0.0::DOUBLE + 0.0::DOUBLE) / 4.0::DOUBLE, 4) AS k FROM documents), "
    "kw AS (SELECT doc_id, k FROM w WHERE k > 0 ORDER BY k DESC, doc_id LIMIT 60), vec AS (SELECT doc_id, round(score, 4) AS v FROM s WHERE score >= 0.05 ORDER BY score DESC, doc_id LIMIT 60), "
    "m AS (SELECT coalesce(kw.doc_id, vec.doc_id) AS chunk_id, k AS keyword, v AS semantic FROM kw FULL JOIN vec ON kw.doc_id = vec.doc_id), "
    "f AS (SELECT m.*, CASE WHEN keyword IS NULL THEN 'vector' WHEN semantic IS NULL THEN 'keyword' ELSE 'hybrid' END AS method, "
    "round(coalesce(semantic, 0) * (0.35::DOUBLE / 1.0::DOUBLE) + coalesce(keyword, 0) * (0.2::DOUBLE / 1.0::DOUBLE) + CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * (0.2::DOUBLE / 1.0::DOUBLE) "
    "+ 0.5::DOUBLE * (0.15::DOUBLE / 1.0::DOUBLE) + 0.5::DOUBLE * (0.1::DOUBLE / 1.0::DOUBLE), 4) AS score FROM m JOIN documents d ON d.doc_id = m.chunk_id) "
    "SELECT chunk_id, keyword, semantic, method, score FROM f ORDER BY score DESC, chunk_id LIMIT 30"
)
def hybrid_rerank(spark, sf_dir):
    """Two pools, by keywords and by the hash vectors of documents and query, merged and ranked by the weighted sum."""
    docs = b.table(spark, sf_dir, "documents")
    keyword = r.keyword_search(_as_chunks(spark, sf_dir).withColumns({"title": F.lit(""), "identity": F.lit("")}), " ".join(_VOCAB), 60)
    asked = hash_sums(spark.createDataFrame([(0, w) for w in _VOCAB], "query_id long, token string"), "query_id")
    sums = hash_sums(docs.select(F.col("doc_id").alias("vec_id"), F.explode(t.tokens(F.col("text"))).alias("token")), "vec_id")
    vector = r.sparse_nearest(sums, asked, 60, 0.05).select(F.col("vec_id").alias("chunk_id"), F.round("score", 4).alias("score"))
    both = r.merged(keyword, vector).join(docs.select("doc_id", "lang"), F.col("chunk_id") == F.col("doc_id"))
    score = r.fused_score(F.col("semantic"), F.col("keyword"), F.when(F.col("lang") == "en", 1.0).otherwise(0.0), F.lit(0.5), r.recency(F.lit(None).cast("double")))
    return both.withColumn("score", score).orderBy(F.desc("score"), "chunk_id").limit(30).select("chunk_id", "keyword", "semantic", "method", "score")


@query(
    f"WITH q AS (SELECT vec_id AS query_id, label AS own, embedding FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT q.query_id, q.own, e.vec_id, e.label, {_COS} AS score FROM q, embeddings e WHERE e.vec_id <> q.query_id), "
    "h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, label = own AS relevant FROM p WHERE score >= 0.05), t AS (SELECT label, count(*) - 1 AS n FROM embeddings GROUP BY 1), "
    "g AS (SELECT *, sum(relevant::INTEGER) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM h WHERE rank <= 20), "
    "a AS (SELECT query_id, any_value(own) AS own, count(*) FILTER (WHERE rank <= 8) AS top, count(*) FILTER (WHERE relevant AND rank <= 8) AS hits, count(*) FILTER (WHERE relevant) AS al, min(rank) FILTER (WHERE relevant) AS fst, sum(so_far::DOUBLE / rank) FILTER (WHERE relevant) AS su FROM g GROUP BY 1) "
    "SELECT query_id, round(CASE WHEN top > 0 THEN hits::DOUBLE / top ELSE 0 END, 4) AS precision_at_k, round(CASE WHEN al > 0 THEN hits::DOUBLE / al ELSE 0 END, 4) AS recall_at_k, round(coalesce(1.0::DOUBLE / fst, 0), 4) AS mrr, "
    "round(coalesce(su / al, 0), 4) AS map, round(CASE WHEN n > 0 THEN al::DOUBLE / n ELSE 0 END, 4) AS true_recall FROM a JOIN t ON t.label = a.own"
)
def ir_metrics(spark, sf_dir):
    """How well the 20 nearest vectors of every row whose id is divisible by 50 have its label: at 8, and against all rows of the label."""
    from pyspark.sql import Window

    rows = b.table(spark, sf_dir, "embeddings")
    found = r.nearest(rows, F.col("vec_id") % 50 == 0, 21, 0.05).where("vec_id <> query_id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("rank <= 20")
    labels, totals = rows.select("vec_id", "label"), rows.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("relevant_total"))
    own = labels.join(totals, "label").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"), "relevant_total")
    hits = found.join(labels, "vec_id").join(own, "query_id").withColumn("relevant", F.col("label") == F.col("own"))
    return r.ranking_measures(hits, 8)


_UNITS = "ghz|mhz|gb|tb|mah|wh|hz|mm|cm|kg|w|g"


@query(f"WITH t AS (SELECT p_partkey, lower(p_name || ' ' || p_size || ' GB ' || p_size % 7 || ',5 kg') AS x FROM part) SELECT p_partkey, unnest(list_transform(regexp_extract_all(x, '([0-9]+(?:[.,][0-9]+)?) ?({_UNITS})\\b', 1), lambda v: replace(v, ',', '.')::DOUBLE)) AS value, unnest(regexp_extract_all(x, '([0-9]+(?:[.,][0-9]+)?) ?({_UNITS})\\b', 2)) AS unit FROM t")
def number_units(spark, sf_dir):
    said = F.concat_ws(" ", "p_name", F.concat_ws("", "p_size", F.lit(" GB")), F.concat_ws("", F.col("p_size") % 7, F.lit(",5 kg")))
    return b.table(spark, sf_dir, "part").select("p_partkey", F.explode(t.numbers_with_units(said)).alias("n")).select("p_partkey", "n.value", "n.unit")


@query("WITH p AS (SELECT unnest(string_split(lower(text), ' ')) AS w, item_id FROM benchmark), q AS (SELECT item_id, list_distinct(list(w)) AS ws FROM p GROUP BY 1) SELECT a.item_id AS a, b.item_id AS b, CASE WHEN len(list_intersect(a.ws, b.ws)) = 0 THEN 0.0::DOUBLE WHEN len(list_intersect(a.ws, b.ws)) = len(a.ws) AND len(a.ws) = len(b.ws) THEN 1.0::DOUBLE WHEN len(list_intersect(a.ws, b.ws)) = len(a.ws) THEN 0.5::DOUBLE WHEN len(list_intersect(a.ws, b.ws)) = len(b.ws) THEN 0.35::DOUBLE ELSE round(least(0.3::DOUBLE, 0.3::DOUBLE * len(list_intersect(a.ws, b.ws)) / len(b.ws)), 6) END AS likeness FROM q a JOIN q b ON b.item_id = a.item_id + 1")
def model_likeness(spark, sf_dir):
    """Words of each benchmark item and of the next one."""
    words = b.table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("ws"))
    met = words.alias("a").join(words.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1)
    return met.select(F.col("a.item_id").alias("a"), F.col("b.item_id").alias("b"), F.round(r.model_likeness(F.col("a.ws"), F.col("b.ws")), 6).alias("likeness"))


@query(
    f"WITH dt AS ({_DOC_TOKENS}), qt AS (SELECT item_id AS id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS tok FROM benchmark), " + _SUMS.format("d") + ", " + _SUMS.format("q") + ", " + _MEET + ", "
    "r AS (SELECT query_id AS item_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score >= 0.05) SELECT item_id, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5"
)
def benchmark_hash_search(spark, sf_dir):
    """For each benchmark item the five documents whose hash vectors, of all their words, are nearest."""
    vectors = _hashed(spark, sf_dir, "documents", "doc_id").withColumnRenamed("doc_id", "vec_id")
    asked = _hashed(spark, sf_dir, "benchmark", "item_id").withColumnRenamed("item_id", "query_id")
    found = r.nearest_to(vectors, asked, 5, 0.05, many=b.table(spark, sf_dir, "documents").count())
    return found.select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))
