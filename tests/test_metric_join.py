"""Pivot blocks: no neighbour is lost, most blocks are skipped, and density clusters equal brute force."""

import numpy as np
import pytest

from callgrid.operators import clustering, metric_join


def clouds(seed, dims=16, n=40, centres=12):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(centres, dims)) * 6
    return np.concatenate([m + r.normal(size=(n, dims)) * 0.3 for m in middle] + [r.normal(size=(30, dims)) * 8])


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>").repartition(4)


def brute(x, eps, least):
    """Cluster of each row: cores are united, a border row takes the smallest cluster it touches."""
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.where(core, np.where(near & core[None], label[None], len(x)).min(1), len(x))
        if (new == label).all():
            break
        label = new
    border = np.where(near & core[None], label[None], len(x)).min(1)
    return [None if v == len(x) else int(v) for v in np.where(core, label, border)]


def clusters(spark, x, eps, least, **sizes):
    got = {r["id"]: r["cluster"] for r in clustering.dbscan(table(spark, x), eps, least, **sizes).collect()}
    return [got[i] for i in range(len(x))]


@pytest.mark.parametrize(("block", "pivots", "visitors"), [(4096, 64, 16384), (16, 8, 32), (5, 1, 7)])
def test_clusters_against_brute_force(spark, block, pivots, visitors):
    """Clouds in 16 dimensions, a chain through many blocks, vectors that many rows hold, whatever the sizes."""
    x = clouds(3)
    chain = np.zeros((60, 16))
    chain[:, 0] = 40 + np.arange(60) * 0.5
    x = np.concatenate([x, chain, np.full((25, 16), 90.0), x[:20], [[-0.0] * 16, [0.0] * 16]])
    for eps, least in ((1.5, 5), (0.5, 2)):
        assert clusters(spark, x, eps, least, block=block, pivots=pivots, visitors=visitors) == brute(x, eps, least)


def test_visits_find_all_neighbours_and_skip_most_blocks(spark):
    x, eps = clouds(5, n=60, centres=20), 1.5
    _, nodes = metric_join.distinct_vectors(table(spark, x))
    own = metric_join.layout(nodes, eps, block=16, pivots=64)
    got = {r["id"]: r["n"] for r in metric_join.weights_near(own, eps).collect()}
    near = (np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps).sum(1)
    assert got == {i: int(n) for i, n in enumerate(near)}
    assert own.points.groupBy("block").count().agg({"count": "max"}).first()[0] <= 3 * 16
    blocks, visits = own.points.select("block").distinct().count(), own.visits.count()
    assert visits < 0.35 * blocks * len(x)


def test_equal_distances_are_cut_by_a_hash(spark):
    """Rows on a sphere about the only pivot share a ring, but no block is above its size by much."""
    r = np.random.default_rng(6)
    x = r.normal(size=(600, 4))
    x = np.concatenate([[[0.0] * 4], x / np.linalg.norm(x, axis=1)[:, None]])
    _, nodes = metric_join.distinct_vectors(table(spark, x))
    own = metric_join.layout(nodes, 0.1, block=32, pivots=1)
    assert own.points.groupBy("block").count().agg({"count": "max"}).first()[0] <= 3 * 32


def test_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.1]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, []), (None, [0.0, 0.0]), (7, [9.0, 9.0])]
    df = spark.createDataFrame([(i, f, "clash") for i, f in rows], "id long, features array<double>, cluster string")
    got = sorted((str(r["id"]), r["cluster"]) for r in clustering.dbscan(df, 0.5, 2).collect())
    assert got == [("1", 1), ("2", 1), *((str(i), None) for i in range(3, 8)), ("None", None)]
    assert clustering.dbscan(df.limit(0), 0.5, 2).count() == 0 and clustering.dbscan(df.where("id = 3"), 0.5, 2).first()["cluster"] is None
