"""Queries of sources and of chunks with their provenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone import bindings as b
from lodestone.operators.chunking import chunked
from lodestone.registry import query
from lodestone.sources.sitemap_source import SitemapSource
from lodestone.tables import shared_dir


@query("SELECT url, count(*) AS n FROM pages WHERE url IS NOT NULL GROUP BY 1")
def sitemap_addresses(spark, sf_dir):
    """The addresses of all pages, written as sitemaps and read through the data source."""
    at = f"{shared_dir(spark)}/sitemaps-{uuid.uuid4().hex}"
    escaped = F.replace(F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    pages = b.table(spark, sf_dir, "pages").where("url is not null")
    pages.select(F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc></url>"))).write.option("compression", "gzip").text(at)
    spark.dataSource.register(SitemapSource)
    return spark.read.format("sitemaps").option("path", at).load().where("error is null").groupBy("url").agg(F.count(F.lit(1)).alias("n"))


_CUT = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_ENDS = " ".join(f"WHEN instr(w, '{mark}') > 0 THEN e - instr(reverse(w), '{mark[::-1]}') + 1" for mark in (". ", " "))


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, source, {_CUT.format("text")} AS t, length(text) - length(regexp_replace(text, '^\\s+', '')) AS before FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, 0 AS lo, 0 AS upto, -1 AS idx, false AS done FROM d WHERE t <> ''
        UNION ALL SELECT doc_id, a, z, idx + (CASE WHEN {_CUT.format("substr(t, a + 1, z - a)")} <> '' THEN 1 ELSE 0 END), z >= length(t)
        FROM (SELECT *, CASE WHEN length(t) > 900 AND cut > a THEN cut ELSE e END AS z
            FROM (SELECT *, CASE WHEN instr(w, chr(10) || chr(10)) > 0 THEN e - instr(reverse(w), chr(10) || chr(10)) + 1 WHEN instr(w, chr(10)) > 0 THEN e - instr(reverse(w), chr(10)) + 1 {_ENDS} END AS cut
                FROM (SELECT *, substr(t, greatest(0, e - 60) + 1, e - greatest(0, e - 60)) AS w
                    FROM (SELECT *, least(a + 900, length(t)) AS e
                        FROM (SELECT c.*, t, CASE WHEN idx < 0 AND upto = 0 THEN 0 WHEN upto - 120 > lo THEN upto - 120 ELSE upto END AS a FROM c JOIN d USING (doc_id) WHERE NOT done AND idx < 23))))))
    SELECT doc_id, source, c.idx::INTEGER AS chunk_index, (before + lo + length(p) - length(regexp_replace(p, '^\\s+', '')))::INTEGER AS start, {_CUT.format("p")} AS content,
        greatest(1, round_even(length({_CUT.format("p")}) / 4.0::DOUBLE, 0))::INTEGER AS approx_tokens
    FROM (SELECT c.*, source, before, substr(t, lo + 1, upto - lo) AS p FROM c JOIN d USING (doc_id) WHERE upto > 0) AS c WHERE {_CUT.format("p")} <> ''"""
)
def document_chunks(spark, sf_dir):
    """The first 24 chunks of every document with its source."""
    return chunked(b.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
