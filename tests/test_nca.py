"""Neighbourhood components: gradient, sums over batches and folds, all rows take part, odd tables."""

import numpy as np

from callgrid.operators import nca


def table(spark, n, seed=0, folds=1):
    """Two classes told apart by a narrow column, beside a wide one without meaning."""
    r = np.random.default_rng(seed)
    y = r.integers(0, 2, n)
    x = np.stack([5 * r.normal(size=n), y + 0.2 * r.normal(size=n), r.normal(size=n)], 1)
    rows = [(i, i % folds, f"c{c}", v) for i, (c, v) in enumerate(zip(y, x.tolist(), strict=True))]
    return x, y, spark.createDataFrame(rows, "id long, fold int, label string, features array<double>")


def test_gradient_is_finite_differences():
    r = np.random.default_rng(0)
    x, y, a = r.normal(size=(12, 4)), r.integers(0, 3, 12), r.normal(size=(2, 4))
    found = nca.hits(a, x, y)[1]
    for i in np.ndindex(a.shape):
        step = np.zeros_like(a)
        step[i] = 1e-6
        assert abs((nca.hits(a + step, x, y)[0] - nca.hits(a - step, x, y)[0]) / 2e-6 - found[i]) < 1e-5


def test_sums_over_batches_and_folds(spark):
    x, y, df = table(spark, 90, 1, folds=2)
    axes = {0: np.array([[1.0, 0.5, 0.0]]), 1: np.array([[0.2, 1.0, 0.3]])}
    means = {0: np.array([1.0, 0.0, 2.0]), 1: np.zeros(3)}
    whole = nca.total_hits(nca.batched(df, size=1000), axes, means)
    for f in (0, 1):
        n, g = nca.hits(axes[f], x[f::2] - means[f], y[f::2])
        assert np.isclose(whole[f][0], n) and np.allclose(whole[f][1], g)
    parts = nca.batched(df, size=10)
    rows = parts.selectExpr("fold", "size(labels) AS n").collect()
    assert len(rows) > 6 and sum(r["n"] for r in rows) == 90
    cut = {r["fold"]: 0.0 for r in rows}
    for r in parts.collect():
        cut[r["fold"]] += nca.hits(axes[r["fold"]], np.array(r["vectors"]) - means[r["fold"]], np.array(r["labels"]))[0]
    assert all(np.isclose(nca.total_hits(parts, axes, means)[f][0], cut[f]) for f in cut)


def test_axes_turn_to_what_tells_classes_apart(spark):
    x, _, df = table(spark, 240, 2)
    axes = nca.neighbourhood_components(df, {0: x.mean(0)}, 1, size=80, rounds=25)[0][0]
    assert np.abs(axes[1]) > np.abs(axes[0]) and np.abs(axes[1]) > np.abs(axes[2])


def test_odd_tables(spark):
    x, _, df = table(spark, 1, 3)
    assert nca.neighbourhood_components(df, {0: x.mean(0)}, 2, rounds=2)[0].shape[1] == 3
    assert nca.neighbourhood_components(df.limit(0), {}, 2) == {}
    unknown = df.withColumn("label", nca.F.lit(None).cast("string"))
    assert nca.total_hits(nca.batched(unknown.unionAll(unknown)), {0: np.eye(3)}, {0: np.zeros(3)})[0][0] == 2
