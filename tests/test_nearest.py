"""Search of vectors by blocks."""

import numpy as np

from lodestone.registry import QUERIES


def test_nearest(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(401, 8))
    x[77] = x[50]
    rows = [(i, v.tolist(), i % 3 or None) for i, v in enumerate(x)] + [(450, None, 1), (500, [0.0] * 8, 1), (550, [1.0, 2.0], 1)]
    schema = "vec_id long, embedding array<double>, label int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "embeddings.parquet"))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {}
    for q in range(0, 401, 50):
        scores = np.round(unit @ unit[q], 6)
        want[q] = [(i, scores[i]) for i in sorted(range(401), key=lambda i: (-scores[i], i))[:10] if scores[i] >= 0.05]
    got = {}
    for r in QUERIES["vector_topk_all"](spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == want | {550: [(550, 1.0)]}
    within = {}
    for r in QUERIES["vector_topk"](spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        within.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in range(0, 401, 50):
        scores = np.round(unit @ unit[q], 6)
        own = [i for i in range(401) if i % 3 == q % 3]
        assert within[q] == [(i, scores[i]) for i in sorted(own, key=lambda i: (-scores[i], i))[:10] if scores[i] >= 0.05], q


def test_nearest_in_blocks(spark):
    from pyspark.sql import functions as F

    from lodestone.operators import retrieval

    x = np.random.default_rng(4).normal(size=(300, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    lists = [sorted(map(tuple, retrieval.nearest(df, F.col("vec_id") % 5 == 0, 7, 0.05, block=b, queries=q).collect())) for b, q in ((8192, 1024), (40, 9))]
    assert lists[0] == lists[1] and len(lists[0]) == 420


def test_no_vectors(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert all(QUERIES[q](spark, str(tmp_path)).count() == 0 for q in ("vector_topk", "vector_topk_all"))
