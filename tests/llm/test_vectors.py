"""Additive quantisation against brute force."""

import math

import numpy as np

from pyspark.sql import functions as F

from lodestone.llm import additive

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=20):
    good = {i: np.array(v, np.float32).astype(np.float64) for i, v, _ in rows if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    out = {}
    for q in ids[ids % 20 == 0]:
        s = (x * good[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[int(q)] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def test_search(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist(), 0) for i in range(900)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(300)]
    rows += [(2000, None, 0), (2020, [], 0), (2040, [0.0] * 16, 0), (2060, [None] + [1.0] * 15, 0), (2080, [math.nan] + [1.0] * 15, 0), (2100, [math.inf] * 16, 0), (2120, [1.0] * 5, 0), (None, rows[0][1], 0), rows[7]]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))
    got = {}
    for r in additive.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute([r for r in rows if r[1] is None or len(r[1]) == 16])
    assert got.keys() == want.keys()
    assert all(len(v) == 20 and q not in dict(v) for q, v in got.items())
    hits = sum(len(dict(v).keys() & dict(want[q]).keys()) for q, v in got.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(abs(s - dict(want[q]).get(i, s)) < 1e-12 for q, v in got.items() for i, s in v)
    assert all(v == sorted(v, key=lambda p: (-p[1], p[0])) for v in got.values())


def test_recall_beyond_the_shortlist(spark, monkeypatch):
    """Many more vectors than are ranked exactly, in several blocks of codes and of queries."""
    monkeypatch.setattr(additive, "SHORTLIST", 120)
    monkeypatch.setattr(additive, "BLOCK", 1500)
    monkeypatch.setattr(additive, "QUERIES", 100)
    monkeypatch.setattr(additive, "SAMPLE", 2000)
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(6000, 24)).astype(np.float32))]
    got = {}
    for r in additive.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    want = brute(rows)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    recall = sum(len(got[q].keys() & dict(v).keys()) for q, v in want.items()) / (20 * len(want))
    assert recall >= 0.9, recall
    assert all(abs(s - dict(want[q]).get(i, s)) < 1e-12 for q, v in got.items() for i, s in v.items())


def test_one_hot_vector_does_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(additive, "SAMPLE", 50)
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(200, 6)).astype(np.float32))] + [(1000 + i, [1.0, 2.0], 0) for i in range(150)]
    assert {r["query_id"] for r in additive.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect()} == set(range(0, 200, 20))


def test_few_and_none(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0], 0), (5, [0.5, 0.5], 0)], SCHEMA)
    assert [tuple(r) for r in additive.search(two, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 5, 0.5)]
    assert additive.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_beam_search_improves():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 12))
    q = additive.fit(x, books=4, words=16)
    codes, norms = q.encode(x)
    assert np.allclose(norms, np.linalg.norm(x, axis=1) / np.linalg.norm(q.decode(codes), axis=1))
    greedy = 0.0
    r = x.copy()
    for b in range(4):
        at = ((q.words[b] ** 2).sum(axis=1) - 2 * r @ q.words[b].T).argmin(axis=1)
        r -= q.words[b][at]
    greedy = (r**2).sum()
    assert ((x - q.decode(codes)) ** 2).sum() <= greedy + 1e-9
