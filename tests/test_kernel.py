"""Kernel features and machines against an exact solver of the dual problem."""

import numpy as np

from callgrid.operators import kernel, models

CLASSES = ("a", "b", "c")


def table(spark, n, seed, classes=CLASSES, dims=3):
    r = np.random.default_rng(seed)
    y = r.integers(0, len(classes), n)
    x = r.normal(size=(n, dims))
    x *= (1 + 2.0 * y / np.linalg.norm(x, axis=1))[:, None]  # shells: no line parts them
    df = spark.createDataFrame([(i, classes[c], [float(v) for v in row]) for i, (c, row) in enumerate(zip(y, x, strict=True))],
        "id long, label string, features array<double>")
    return x, y, df


def exact(k, sign, box, rounds=20_000):
    """Decision values on the rows themselves: pairs of multipliers that violate most, until none does."""
    a, grad = np.zeros(len(sign)), -np.ones(len(sign))
    q = k * np.outer(sign, sign)
    for _ in range(rounds):
        s = -sign * grad
        up, down = np.where(sign > 0, a < box, a > 0), np.where(sign > 0, a > 0, a < box)
        i, j = np.where(up, s, -np.inf).argmax(), np.where(down, s, np.inf).argmin()
        if s[i] - s[j] < 1e-8:
            break
        step = (s[i] - s[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, box[i] - a[i] if sign[i] > 0 else a[i], a[j] if sign[j] > 0 else box[j] - a[j])
        a[i], a[j] = a[i] + sign[i] * step, a[j] - sign[j] * step
        grad += step * (q[:, i] * sign[i] - q[:, j] * sign[j])
    return k @ (a * sign) + (s[i] + s[j]) / 2


def test_gamma_and_features_give_the_kernel(spark):
    x, _, df = table(spark, 60, 1)
    assert abs(kernel.scale_gamma(df) - 1 / (3 * x.var())) < 1e-12
    own = kernel.kernel_map(df, landmarks=60)
    y = np.array([r["features"] for r in own.apply(df.withColumn("more", df["id"])).orderBy("id").collect()])
    want = kernel.gaussian(x, x, 1 / (3 * x.var()))
    assert np.allclose(y @ y.T, want, atol=1e-6)
    few = kernel.kernel_map(df, landmarks=40)
    z = few.features(x)
    assert np.abs(z @ z.T - want).mean() < 0.05 and len(few.landmarks) == 40


def test_margins_are_near_the_exact_ones(spark):
    """All rows are landmarks, so only the solvers differ."""
    x, y, df = table(spark, 80, 2, CLASSES[:2])
    own = kernel.kernel_map(df)
    ready = models.balanced(models._ready(own.apply(df), CLASSES[:2]))
    machine = kernel.fit_machines(ready, 3.0, 400)
    got = {r["id"]: r["m"] for r in ready.select("id", machine.margins()[0].alias("m")).collect()}
    weight = len(y) / (2 * np.bincount(y))[y]
    want = exact(kernel.gaussian(x, x, own.gamma), np.where(y == 0, 1.0, -1.0), 3.0 * weight)
    got = np.array([got[i] for i in range(len(y))])
    assert np.corrcoef(got, want)[0, 1] > 0.99 and np.abs(got - want).mean() < 0.1
    assert ((got > 0) == (want > 0)).mean() > 0.97


def test_votes_and_shells(spark):
    _, _, df = table(spark, 150, 3)
    few, (_, _, other) = {"svm_iterations": 25}, table(spark, 100, 4)
    out = models.predictions(df, other, "rbf_svm", CLASSES, sizes=few).collect()
    hits = np.mean([r["y_true_label"] == r["y_pred_label"] for r in out])
    line = np.mean([r["y_true_label"] == r["y_pred_label"] for r in models.predictions(df, other, "linear_svm", CLASSES, sizes=few).collect()])
    assert len(out) == 100 and hits > 0.7 and hits > line + 0.15
    alone = models.predictions(df.where("label = 'b'"), other, "linear_svm", CLASSES)
    assert {r["y_pred_label"] for r in alone.collect()} == {"b"}
    tie = kernel.Machines([(0, 1, [1.0], 0.0), (0, 2, [-1.0], 0.0), (1, 2, [1.0], 0.0)], 0)  # one vote each
    rows = spark.createDataFrame([([1.0],)], "features array<double>")
    assert tie.transform(rows).first()["prediction"] == 0.0
