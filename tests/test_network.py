"""The network: gradients against finite differences and against one machine, the end of the fit, odd tables."""

import numpy as np
import pytest

from callgrid.operators import models, network

CLASSES = ("a", "b", "c")


def table(spark, n, seed, spread=1.0):
    r = np.random.default_rng(seed)
    y = r.integers(0, 3, n)
    x = 4 * np.eye(5)[y] + spread * r.normal(size=(n, 5))
    rows = [(i, CLASSES[c], c, [float(v) for v in v]) for i, (c, v) in enumerate(zip(y.tolist(), x, strict=True))]
    return x, y, spark.createDataFrame(rows, "id long, label string, label_idx int, features array<double>")


def test_gradients_are_finite_differences():
    r = np.random.default_rng(0)
    w, x, y = network.first_weights((4, 6, 3), 1), r.normal(size=(9, 4)), r.integers(0, 3, 9)
    found, at = network.flat(network.gradients(w, x, y)[1]), network.flat(w)
    for i in range(len(at)):
        step = np.zeros_like(at)
        step[i] = 1e-6
        up, down = (network.gradients(network.shaped(at + s, w), x, y)[0] for s in (step, -step))
        assert abs((up - down) / 2e-6 - found[i]) < 1e-4


def test_sums_of_tasks(spark):
    x, y, df = table(spark, 60, 1)
    w = network.first_weights((5, 7, 3), 0)
    rows = df.selectExpr("IF(id % 4 = 3, -1, CAST(id % 2 AS INT)) AS batch", "label_idx", "features").repartition(5)
    s = network.summed(rows, w, [0, network.HELD_OUT])
    own, held = np.arange(60) % 4 % 2 == 0, np.arange(60) % 4 == 3
    loss, g = network.gradients(w, x[own], y[own])
    assert (s.rows, s.held) == (own.sum(), held.sum()) and np.isclose(s.loss, loss) and np.allclose(s.gradients, network.flat(g))
    assert s.hits == (network.scores(w, x[held])[1].argmax(1) == y[held]).sum()


def test_the_best_epoch_is_kept_and_the_fit_ends(spark):
    x, y, df = table(spark, 250, 2, 0.7)
    model = network.fit_network(df, 3, hidden=32, epochs=60)
    n = len(model.held_out)
    assert network.PATIENCE < n < 60 and model.losses[-1] < model.losses[0]
    held = df.where("pmod(xxhash64(0, 'held out', id), 10) = 0")
    share = model.transform(held).selectExpr("avg(CAST(prediction = label_idx AS DOUBLE))").first()[0]
    assert np.isclose(share, max(model.held_out))
    assert model.held_out.index(max(model.held_out)) <= n - network.PATIENCE
    out = models.predictions(df, df, "mlp", CLASSES, sizes={"hidden": 32, "mlp_iterations": 60}).toPandas()
    assert len(out) == 250 and (out["y_true_label"] == out["y_pred_label"]).mean() > 0.9


def test_odd_tables(spark):
    _, _, df = table(spark, 3, 3)
    unknown = df.withColumn("label_idx", network.F.when(network.F.col("id") > 0, network.F.col("label_idx")))
    assert network.fit_network(unknown, 3, hidden=4, epochs=2).transform(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        network.fit_network(df.limit(0), 3)
    extra = network.fit_network(df, 3, hidden=4, epochs=2).transform(df.withColumn("batch", network.F.lit("x")))
    assert extra.columns == ["id", "label", "label_idx", "features", "batch", "prediction"]
