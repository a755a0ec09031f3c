"""Mutual information over sorted ranges against the estimate of one column in memory."""

import numpy as np
import pytest

from callgrid.operators import information, prep


def table():
    r = np.random.default_rng(7)
    n = 900
    y = np.where(r.random(n) < 0.7, "hot", r.choice(["b", "c", "d"], n))
    x = {0: r.normal(size=n) + (y == "hot"), 1: r.normal(size=n) * 1e6, 2: np.unique(y, return_inverse=True)[1] * 5.0 + r.random(n), 3: r.exponential(size=n)}
    y[:1] = "alone"
    return x, y


def scores(spark, rows, tasks, k=3):
    df = spark.createDataFrame(rows, "pos int, label string, x double").repartition(3)
    return {r["pos"]: r["score"] for r in information.mutual_information_scores(df, ["pos"], tasks=tasks, k=k).collect()}


@pytest.mark.parametrize(("tasks", "k"), [(1, 3), (7, 3), (40, 5)])
def test_columns_of_many_ranges(spark, tasks, k):
    """Ranges smaller and larger than a label, in one plan for all columns."""
    x, y = table()
    got = scores(spark, [(p, str(c), float(v)) for p, column in x.items() for c, v in zip(y, column, strict=True)], tasks, k)
    for p, column in x.items():
        assert abs(got[p] - prep.mutual_information(column, y, k)) < 1e-9, p


def test_ranges_shorter_than_the_neighbourhood(spark):
    r = np.random.default_rng(8)
    x, y = r.normal(size=25), np.array(["a", "b"] * 12 + ["a"])
    got = scores(spark, [(0, c, float(v)) for c, v in zip(y, x, strict=True)], 25, 4)
    assert abs(got[0] - prep.mutual_information(x, y, 4)) < 1e-9


def test_odd_columns(spark):
    """Ties are broken by noise; nulls are left out; a column without values, and one whose labels have a row each."""
    r = np.random.default_rng(9)
    ties, y = r.integers(0, 4, 600).astype(float), r.choice(["a", "b"], 600)
    rows = [(0, c, float(v)) for c, v in zip(y, ties, strict=True)] + [(1, "a", None), (1, "b", float("nan"))] + [(2, "a", 1.0), (2, "b", 2.0)]
    rows += [(3, c, float(v)) for c, v in zip(["a"] * 50 + ["b"] * 50, np.r_[np.zeros(50), np.ones(50)], strict=True)] + [(4, None, 1.0 + i) for i in range(9)]
    got = scores(spark, rows, 5)
    assert set(got) == {0, 1, 2, 3, 4} and got[1] is None and got[2] == 0.0 and got[4] == 0.0
    assert abs(got[0] - prep.mutual_information(ties, y)) < 0.06 and got[3] > 0.6


def test_digamma(spark):
    out = spark.range(1, 300).select("id", information.digamma(information.F.col("id")).alias("d")).collect()
    assert all(abs(r["d"] - prep.digamma(r["id"])) < 1e-12 for r in out)


def test_registered_query_against_one_column(spark):
    from conftest import TESTDATA

    from callgrid.plans import queries

    got = {r["pos"]: (r["score"], r["selected"]) for r in queries.QUERIES["q51_select_k_best_mi"](spark, TESTDATA).collect()}
    rows = queries.T.vectors(spark, TESTDATA).select("label", "features").collect()
    x, y = np.array([r["features"] for r in rows], float), np.array([str(r["label"]) for r in rows])
    want = {p: prep.mutual_information(x[:, p], y) for p in range(x.shape[1])}
    assert set(got) == set(want) and all(abs(got[p][0] - want[p]) < 1e-3 for p in want)  # near ties fall by the noise
