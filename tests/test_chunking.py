"""Chunks as a table function, against cutting one by one."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, retrieval


def test_same_chunks_with_provenance(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice(["lorem", "é", " ", "  ", ". ", "\n", "\n\n", "x" * 90]) for _ in range(n))
    texts = [make(n) for n in (0, 1, 5, 40, 200, 900)] + [None, "  \n ", "y" * 5000, "a" * 100, "  " + "b c " * 80]
    docs = spark.createDataFrame([(i, t, f"https://a.example.org/{i}", "own") for i, t in enumerate(texts)], "doc_id int, text string, url string, content string")
    got = {}
    for r in chunking.chunked(docs, size=100, overlap=20, most=24).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r)
        assert r["url"] == f"https://a.example.org/{r['doc_id']}" and texts[r["doc_id"]][r["start"] :].startswith(r["content"])
        assert r["approx_tokens"] == max(1, round(len(r["content"]) / 4))
    cut = docs.select("doc_id", retrieval.chunks("text", F.lit(100), F.lit(20)).alias("parts")).collect()
    assert {i: [r["content"] for r in rows] for i, rows in got.items()} == {r["doc_id"]: r["parts"][:24] for r in cut if r["parts"]}
    assert all([r["chunk_index"] for r in rows] == list(range(len(rows))) for rows in got.values()) and max(map(len, got.values())) == 24


def test_sql_and_wrong_arguments(spark):
    spark.udtf.register("chunk_rows", chunking.chunk_rows)
    spark.createDataFrame([(1, "uno dos tres cuatro"), (2, None)], "id int, text string").createOrReplaceTempView("some_texts")
    got = spark.sql("SELECT id, content, start FROM some_texts, LATERAL chunk_rows(text, 9, 0, 2)").collect()
    assert [tuple(r) for r in got] == [(1, "uno dos", 0), (1, "tres", 8)]
    for bad in ("text, 9, 9, 2", "text, 0, 0, 1", "id, 9, 0, 2", "text, id, 0, 2", "text, 9, 0, -1"):
        with pytest.raises(Exception, match="chunk_rows"):
            spark.sql(f"SELECT * FROM some_texts, LATERAL chunk_rows({bad})").collect()


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id int, text string, start string")
    assert chunking.chunked(empty).columns == ["doc_id", "chunk_index", "start", "content", "approx_tokens"] and chunking.chunked(empty).count() == 0
    twice = spark.createDataFrame([(1, "x")] * 2, "doc_id int, text string")
    assert chunking.chunked(twice).count() == 2 and chunking.chunked(twice, most=0).count() == 0


def test_a_task_cuts_a_few_texts_at_a_time():
    """A batch of 1000 texts, one of them long, comes back in pieces."""
    texts = pa.array([None if i % 7 == 0 else f"text {i} " * 30 for i in range(999)] + ["word " * 400_000])
    made = list(retrieval.chunks.func(iter([(texts, pa.array([100] * 1000), pa.array([20] * 1000))])))
    assert [len(x) for x in made] == [256, 256, 256, 231, 1]
    assert made[0][0].as_py() == [] and made[0][1].as_py()[0].startswith("text 1 text 1")
