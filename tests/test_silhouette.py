"""Sums of distances by products, against differences; blocks that meet once, against the full matrix."""

import numpy as np

from callgrid.operators import clustering, knn


def test_sums_of_both_sides():
    r = np.random.default_rng(3)
    x, y = r.normal(size=(700, 5)) + 1000, r.normal(size=(1300, 5)) + 1000
    y[:200] = x[:200] + 1e-7 * (np.arange(200)[:, None] % 2)  # copies and near copies, far from the origin
    of_x, of_y = np.eye(3)[r.integers(0, 3, 700)], np.eye(2)[r.integers(0, 2, 1300)]
    d = knn.distances(x, y, "euclidean")
    rows, columns = clustering.distance_sums(x, y, of_x, of_y)
    assert np.allclose(rows, d @ of_y, rtol=1e-11, atol=0) and np.allclose(columns, d.T @ of_x, rtol=1e-11, atol=0)


def test_blocks_and_many_clusters(spark):
    r = np.random.default_rng(4)
    x, cluster = np.repeat(r.normal(size=(30, 4)), 3, 0), r.integers(0, 70, 90)  # copies; more clusters than are summed at a time
    rows = spark.createDataFrame([(i, int(cluster[i]), x[i].tolist()) for i in range(90)], "id long, cluster long, features array<double>")
    got = {v["id"]: v["silhouette"] for v in clustering.silhouette(rows, block=20).collect()}
    d = knn.distances(x, x, "euclidean")
    for i in range(90):
        means = {c: d[i, [j for j in range(90) if cluster[j] == c and j != i]].mean() for c in set(cluster.tolist()) if (cluster == c).sum() > (c == cluster[i])}
        a, b = means.pop(int(cluster[i]), None), min(v for c, v in means.items() if c != cluster[i])
        want = 0 if a is None or max(a, b) == 0 else (b - a) / max(a, b)
        assert abs(got[i] - want) < 1e-9
