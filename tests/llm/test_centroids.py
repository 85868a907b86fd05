"""Exact clustering against plain integers."""

import hashlib

import numpy as np

from factloom.llm import centroids


def plain(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * np.float64(np.float32(c)))) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(x) for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for j in range(len(cents)):
            mine = [x for (_, x), c in zip(kept, own) if c == j]
            if mine:
                cents[j] = [sum(col) // len(mine) for col in zip(*mine)]
    last = [nearest(x) for _, x in kept]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    sums = [sum(d for d, c in last if c == j) for j in range(len(cents))]
    return sorted(((i if i is not None else -1, j, d, sums[j], sum(sums), sha[j]) for (i, _), (d, j) in zip(kept, last)))


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("label", "x").selectExpr("*", "'a' as cluster", "1 as x").repartition(parts)
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in centroids.centroid_clusters(df).collect())


def test_equals_plain_integers_with_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(c) for c in rng.normal(size=64).astype(np.float32) + 3 * (k % 5)]) for k in range(200)]
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, rows[3][1]), (500, None), (501, [1.0] * 63), (502, [1.0] * 65), (503, [float("nan")] + [0.0] * 63), (504, [None] + [0.0] * 63), (505, [float("-inf")] + [0.0] * 63), (506, []), (507, [0.0] * 64)]
    assert run(spark, rows) == plain(rows)


def test_ties_copies_and_few_vectors(spark):
    rows = [(k, [float(k % 2)] * 64) for k in range(12)]  # all equal or one of two: equal centroids, empty clusters
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows[:3]) == plain(rows[:3])
    assert run(spark, []) == []


def test_dot_products_are_exact_after_all_rounds(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(k, [float(c) for c in rng.uniform(-9, 9, 64)]) for k in range(60)], "vec_id long, embedding array<float>")
    rows, cents = centroids.clustered(df, k=4)
    for r in rows.collect():
        assert r["dots"] == [sum(a * int(b) for a, b in zip(r["x"], c)) for c in cents]
