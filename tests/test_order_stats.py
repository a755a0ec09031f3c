"""Exact quantiles by rounds against numpy, on ties, huge spans, groups without values, and many brackets."""

import numpy as np
import pytest

from callgrid.operators import order_stats


def columns():
    r = np.random.default_rng(4)
    return {
        0: r.normal(size=4000), 1: np.round(r.normal(size=4000), 1), 2: np.full(3000, 2.5), 3: np.concatenate([np.zeros(2500), r.normal(size=1500)]),
        4: r.normal(size=3000) * 10.0 ** r.integers(-300, 300, 3000), 5: np.array([7.0]), 6: np.array([]), 7: np.array([1.0, 2.0]),
        8: np.concatenate([np.full(2000, 1.0), np.full(2000, 2.0)]), 9: np.concatenate([np.full(3999, -1e300), [1e300]]),
    }


@pytest.mark.parametrize(("few", "splitters"), [(100_000, 512), (20, 8), (1, 4), (300, 64)])
def test_quantiles_against_numpy(spark, few, splitters):
    """With few values to a bracket, several rounds are needed; results are the same to the last bit but of the mean of two."""
    data, shares = columns(), (0.0, 0.1, 0.25, 0.5, 0.5001, 0.75, 0.99, 1.0)
    rows = [(k, float(v)) for k, x in data.items() for v in x] + [(6, None), (6, float("nan")), (0, None), (0, float("nan"))]
    df = spark.createDataFrame(rows, "pos int, x double").repartition(5)
    got = {r["pos"]: r["q"] for r in order_stats.quantiles(df, ["pos"], shares, few=few, splitters=splitters).collect()}
    assert set(got) == set(data) and got[6] is None
    for k, x in data.items():
        if len(x):
            assert np.allclose(got[k], np.quantile(x, shares), rtol=1e-12, atol=0), k


def test_quantiles_equal_the_built_in_function(spark):
    df = spark.range(5000).selectExpr("id % 3 AS fold", "int(id % 7) AS pos", "double(hash(id)) AS x").where("pos <> 4 OR fold <> 1")
    got = order_stats.quantiles(df, ["fold", "pos"], [0.2, 0.5, 0.9], few=10, splitters=16)
    want = df.groupBy("fold", "pos").agg(order_stats.F.percentile("x", order_stats.F.array(*map(order_stats.F.lit, (0.2, 0.5, 0.9)))).alias("w"))
    rows = got.join(want, ["fold", "pos"]).collect()
    assert len(rows) == 20 and all(np.allclose(r["q"], r["w"], rtol=1e-13) for r in rows)


def test_quantiles_of_nothing(spark):
    assert order_stats.quantiles(spark.createDataFrame([], "pos int, x double"), ["pos"], [0.5]).count() == 0
