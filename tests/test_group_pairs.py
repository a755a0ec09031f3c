"""Density clusters at size: a row is sent to few pairs of groups, once for both, whatever blocks it visits there."""

import numpy as np

from callgrid.operators import clustering
from callgrid.operators import metric_join as M
from tests.test_metric_join import brute, clouds, clusters, table


def sent(spark):
    """Bytes written to shuffles so far."""
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_what_a_pass_moves_and_stages(spark):
    """Vectors without structure, which visit about every block. Before, each visit was a row with its 64 numbers, staged and
    then shuffled."""
    x = np.random.default_rng(2).standard_normal((2000, 64)).astype(np.float32)
    _, nodes = M.distinct_vectors(table(spark, x / np.linalg.norm(x, axis=1)[:, None].astype(np.float32)))
    own = M.layout(nodes, 1.0, block=128)
    before = sent(spark)
    assert M.weights_near(own, 1.0).count() == 2000
    assert own.visits.count() > 20 * 2000 and set(own.visits.columns) == {"id", "block"}
    assert sent(spark) - before < 4 * x.nbytes


def test_rounds(spark, monkeypatch):
    """Pairs of groups that are met in rounds give the same clusters; a border row between two of them takes the smaller."""
    monkeypatch.setattr(M, "COPIES", 2)
    x = np.concatenate([clouds(9, dims=3, n=12, centres=6), np.repeat(np.arange(40.0)[:, None] * 0.7 + 60, 3, 1), [[0.1] * 3] * 4, [[1e4] * 3]])
    assert clusters(spark, x, 1.5, 3, block=16, visitors=40) == brute(x, 1.5, 3)


def test_negative_ids_and_doubles(spark):
    """Ids below 0, and numbers that single precision does not hold: distances on both sides of the limit by their last digits."""
    rows = [(-5, [0.0]), (-3, [0.1]), (-1, [0.1 + 1e-12]), (7, [0.2 + 2e-12]), (8, [0.3 + 2e-12])]
    df = spark.createDataFrame(rows, "id long, features array<double>")
    got = {r["id"]: r["cluster"] for r in clustering.dbscan(df, 0.1, 2, block=1, visitors=1, pivots=2).collect()}
    x = np.array([v for _, v in rows])
    want = [None if c is None else rows[c][0] for c in brute(x, 0.1, 2)]
    assert [got[i] for i, _ in rows] == want


def test_pairs_as_by_differences():
    r = np.random.default_rng(3)
    for x in (r.standard_normal((600, 5)), r.integers(0, 3, (500, 3)).astype(float), r.standard_normal((300, 4)) * 1e4, np.ones((50, 2)), r.standard_normal((9, 1)) + 1e9):
        for eps in (0.0, 0.5, 1.0, 2.0, 3e3):
            got = np.zeros((70, len(x)), bool)[: len(x)]
            for i, j in M.bounded(x[:70], x, eps)(np.arange(len(x[:70])), np.arange(len(x))):
                assert not got[i, j].any()
                got[i, j] = True
            assert (got == (M._far(x, x[:70]).T <= eps)).all()


def test_unite():
    root = np.arange(12)
    M.unite(root, np.array([11, 3, 5, 9, 2]), np.array([9, 5, 9, 1, 2]))
    assert root.tolist() == [0, 1, 2, 1, 4, 1, 6, 7, 8, 1, 10, 1]
