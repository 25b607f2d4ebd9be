"""The operators on vectors as whole numbers, against brute force without Spark."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from lodestone.llm import bisectors, dual_tree, norm_search

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [(90001, None, 0), (90050, [None] + [1.0] * 63, 0), (90100, [math.nan] + [1.0] * 63, 1), (90150, [math.inf] * 64, None)]


def whole(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def clustered(n, seed, dims=64, spread=0.4, centres=12):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    x = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1)[:, None]


def best_products(rows, k):
    kept = sorted({(i, tuple(whole(v, 256))) for i, v, *_ in rows if i is not None and usable(v)})
    out = []
    for q, a in kept:
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in kept if i != q and len(a) == len(b))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return out


def searched(spark, rows, k=5):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).withColumn("vec", F.lit(1))
    return sorted(tuple(r) for r in norm_search.search(df, F.col("vec_id") % 50 == 0, k=k).collect())


@pytest.mark.parametrize("bucket, block", [(4096, 4096), (40, 3)])
def test_norm_search(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(norm_search, "BUCKET", bucket)
    monkeypatch.setattr(norm_search, "QUERIES", block)
    x = clustered(500, 1) * np.random.default_rng(2).lognormal(0, 1, 500)[:, None]
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[50][1], 0) for i in range(120)] + [(2000 + i, rows[7][1], 0) for i in range(20)]
    rows += [(3000, [0.0] * 64, 0), (3001, [0.0] * 64, 0), (3050, [1.0, 2.0], 0), (3051, [-1.0, 0.5], 0), (3100, [], 0), (None, rows[0][1], 0), rows[3], rows[100], *ODD]
    assert searched(spark, rows) == best_products(rows, 5)


def test_norm_search_prunes_by_coordinates(spark, monkeypatch):
    """Near copies lie within a small angle: most buckets are read through an interval of one coordinate."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 64))[rng.integers(0, 60, 3000)] + 0.02 * rng.normal(size=(3000, 64))
    x = 5 * x / np.linalg.norm(x, axis=1)[:, None]  # a bucket holds vectors of like length
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    p, ids = np.array([whole(v, 256) for _, v, _ in rows]), np.arange(3000)
    squares = (p * p).sum(axis=1)
    bucket = pd.DataFrame({"cls": ids, "vec": list(p), "square": squares})
    scores = p[:60] @ p.T
    queries = pd.DataFrame({"query": ids[:60], "vec": list(p[:60]), "square": squares[:60], "least": np.sort(scores, axis=1)[:, -6]})
    seen = []
    plain = norm_search.products
    monkeypatch.setattr(norm_search, "products", lambda q, v, m: seen.append(len(q) * len(v)) or plain(q, v, m))
    got = norm_search._within(bucket, queries, 6)
    assert sum(seen) < 0.2 * 60 * 3000
    for i in range(60):
        own = got[got[:, 0] == i]
        assert [tuple(r) for r in own[:, 1:]] == sorted(((j, s) for j, s in enumerate(scores[i].tolist())), key=lambda t: (-t[1], t[0]))[:6]
    monkeypatch.setattr(norm_search, "BUCKET", 256)
    some = [(i, v, 0) for i, v, _ in rows[:800]]
    assert searched(spark, some) == best_products(some, 5)


def test_norm_search_floor_leaves_buckets_out(spark, monkeypatch):
    seen = []
    plain = norm_search._met
    monkeypatch.setattr(norm_search, "BUCKET", 50)
    monkeypatch.setattr(norm_search, "_met", lambda c, w, p, k: seen.append(sum(q * (b - a) for _, q, _, a, b in p)) or plain(c, w, p, k))
    x = clustered(600, 4, centres=1, spread=0.2) * np.repeat([100.0, 1.0], 300)[:, None]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    assert searched(spark, rows) == best_products(rows, 5)
    assert seen[0] <= 2 and seen[1] <= 0.7 * 12, seen  # of about 12 buckets the short half is never met


def test_norm_search_large_numbers(spark):
    big = [(i, (v * 3e4).tolist(), 0) for i, v in enumerate(clustered(120, 5))]
    assert searched(spark, big) == best_products(big, 5)
    q = np.array([[2**30, 1]])
    assert norm_search.products(q, q, 2.0**60)[0, 0] == 2**60 + 1


def test_norm_search_few_and_none(spark):
    assert searched(spark, []) == [] and searched(spark, ODD) == []
    assert searched(spark, [(0, [1.0, 0.0], 0)]) == [] and searched(spark, [(0, [1.0, 0.0], 0), (5, [0.5, -0.5], 0)]) == [(0, 1, 5, 128 * 256)]


def plain_clusters(rows, k=40, rounds=5):
    kept = [(i, whole(v, 256)) for i, v, *_ in rows if usable(v) and len(v) == 64]
    x = np.array([v for _, v in kept], object).reshape(len(kept), 64)
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [list(v) for _, v in first]

    def near():
        d = np.array([[((v - np.array(m, object)) ** 2).sum() for m in c] for v in x])
        return d.argmin(axis=1), d.min(axis=1)

    for _ in range(rounds):
        own, _ = near()
        c = [[int(s) // int((own == j).sum()) for s in x[own == j].sum(axis=0)] if (own == j).any() else m for j, m in enumerate(c)]
    own, d = near()
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    out = [(i, int(o), int(e), int(d[own == o].sum()), int(d.sum()), digest[o]) for (i, _), o, e in zip(kept, own, d, strict=True)]
    return sorted(out, key=repr)


COLUMNS12 = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clusters(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cluster", F.lit("clash")).repartition(5)
    return sorted((tuple(r[c] for c in COLUMNS12) for r in bisectors.reported(bisectors.cluster(df, **more)).collect()), key=repr)


def test_bisector_clusters(spark):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(clustered(260, 6))]
    rows += [(500 + i, rows[0][1], 0) for i in range(100)] + [(700, [1.0] * 63, 0), (701, [], 0), rows[5], rows[5], *ODD]
    assert clusters(spark, rows) == plain_clusters(rows)


def test_bisector_ties_and_few(spark):
    """Vectors between two centroids, equal centroids, fewer vectors than centroids, none."""
    grid = [(i, [float(i % 5), float(i % 3)] + [0.0] * 62, 0) for i in range(90)]
    assert clusters(spark, grid) == plain_clusters(grid)
    assert clusters(spark, grid[:7]) == plain_clusters(grid[:7])
    assert clusters(spark, ODD[:1]) == [] and clusters(spark, []) == []
    null = [(None, [3.0] * 64, 0), *grid[:4]]
    assert clusters(spark, null) == plain_clusters(null)


def test_bisectors_need_one_sign_less_than_centroids(monkeypatch):
    rng = np.random.default_rng(8)
    c, x = rng.integers(-200, 200, (13, 6)), rng.integers(-200, 200, (500, 6))
    c[5] = c[2]
    field, seen = bisectors.bisectors(c.tolist()), []
    plain = bisectors.Bisectors._match
    monkeypatch.setattr(bisectors.Bisectors, "_match", lambda self, v, a, b: seen.append(len(v)) or plain(self, v, a, b))
    near, distance = field.nearest(x)
    every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (near == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all() and sum(seen) == 12 * 500


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, whole(v, 1024), g) for i, v, g in rows if usable(v) and len(v) == 64]
    x = np.array([v for _, v, _ in kept], np.int64).reshape(len(kept), parts, -1)
    start = sorted((i is None, i or 0, v) for i, v, _ in kept)[:entries]
    books = np.array([v for *_, v in start], np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2)

    def near():
        d = np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)], axis=1)
        return d.argmin(axis=2), d.min(axis=2).sum(axis=1)

    for _ in range(rounds):
        own, _ = near()
        for p in range(parts):
            for e in range(len(start)):
                if (own[:, p] == e).any():
                    books[p, e] = x[own[:, p] == e, p].sum(axis=0) // (own[:, p] == e).sum()
    own, error = near()
    labels = {}
    for (_, _, g), e in zip(kept, error, strict=True):
        labels[g] = labels.get(g, 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    out = [(i, "".join(f"{c:02x}" for c in o), int(e), labels[g], digest) for (i, _, g), o, e in zip(kept, own, error, strict=True)]
    return sorted(out, key=repr)


COLUMNS13 = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def codes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("vec", F.lit("clash")).repartition(3)
    return sorted((tuple(r[c] for c in COLUMNS13) for r in dual_tree.reported(dual_tree.compress(df)).collect()), key=repr)


def test_dual_tree_codes(spark, monkeypatch):
    rows = [(i, v.tolist(), i % 7 if i % 11 else None) for i, v in enumerate(clustered(900, 9))]
    rows += [(2000 + i, rows[4][1], 1) for i in range(300)] + [(3000, [1.0] * 63, 0), rows[6], rows[6], *ODD]
    want = plain_codes(rows)
    assert codes(spark, rows) == want
    monkeypatch.setattr(dual_tree, "BLOCK", 50)
    monkeypatch.setattr(dual_tree, "LEAF", 3)
    assert codes(spark, rows) == want


def test_dual_tree_ties_and_few(spark):
    grid = [(i, [float(i % 4), float(i % 3) / 2] * 32, i % 2) for i in range(300)]
    assert codes(spark, grid) == plain_codes(grid)
    assert codes(spark, grid[:5]) == plain_codes(grid[:5]) and codes(spark, grid[:1]) == plain_codes(grid[:1])
    assert codes(spark, [(None, [2.0] * 64, None), *grid[:3]]) == plain_codes([(None, [2.0] * 64, None), *grid[:3]])
    assert codes(spark, []) == [] and codes(spark, ODD[:2]) == []


def test_dual_tree_assigns_whole_nodes():
    """Tight groups go to their entries by node sums; both kinds together give each part its nearest entry."""
    rng = np.random.default_rng(10)
    entries = rng.integers(-2000, 2000, (40, 16))
    x = entries[rng.integers(0, 40, 3000)] + rng.integers(-3, 4, (3000, 16))
    depth = dual_tree._depth(len(x))
    order = dual_tree.halved(x, depth)
    data, by = dual_tree.tree(x[order], depth), dual_tree.book(entries)
    found = dual_tree.assign(data, depth, by)
    chosen, as_whole = np.full(len(x), -1), 0
    for level, node, e in found.whole:
        own = data.range(level, node)
        assert data.count[level][node] == own.stop - own.start and (data.total[level][node] == data.points[own].sum(axis=0)).all()
        chosen[own] = e
        as_whole += own.stop - own.start
    for leaf, some in found.leaves:
        chosen[data.range(depth, leaf)] = some
    assert (chosen == ((data.points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert as_whole > len(x) / 2
