"""Multinomial boosting: falling deviance, one split against numpy, and predictions that follow from the rounds."""

import numpy as np
import pytest

from callgrid.operators import boosting, models

CLASSES = ("a", "b", "c")


def table(spark, n, seed, classes=CLASSES):
    r = np.random.default_rng(seed)
    y = r.integers(0, len(classes), n)
    x = np.round(np.stack([y + r.normal(size=n), r.normal(size=n)], 1) * 3) / 3  # few values: every split is a candidate
    rows = [(i, classes[c], [float(v) for v in row]) for i, (c, row) in enumerate(zip(y, x, strict=True))]
    return x, y, spark.createDataFrame(rows, "id long, label string, features array<double>")


def test_one_split_against_numpy(spark):
    x, y, df = table(spark, 150, 1)
    x = np.clip(x, -1, 3)
    df = df.withColumn("features", boosting.F.transform("features", lambda v: boosting.F.greatest(boosting.F.lit(-1.0), boosting.F.least(boosting.F.lit(3.0), v))))
    model = boosting.boost(models._ready(df, CLASSES), 3, rounds=1, depth=1)
    share = np.bincount(y, minlength=3) / len(y)
    want = np.tile(np.log(share), (len(y), 1))
    for c in range(3):
        res = (y == c) - share[c]
        splits = [(((res[m] - res[m].mean()) ** 2).sum() + ((res[~m] - res[~m].mean()) ** 2).sum(), m)
            for f in range(2) for t in np.unique(x[:, f])[:-1] for m in [x[:, f] <= t]]
        m = min(splits, key=lambda s: s[0])[1]
        for side in (m, ~m):
            r = res[side]
            want[side, c] += 0.1 * 2 / 3 * r.sum() / (np.abs(r) * (1 - np.abs(r))).sum()
    got = {r["id"]: r["raw"] for r in model.transform(models._ready(df, CLASSES)).collect()}
    assert np.allclose([got[i] for i in range(len(y))], want)


def test_deviance_falls_and_rows_are_told_apart(spark):
    _, _, df = table(spark, 150, 2)
    ready = models._ready(df, CLASSES)
    model = boosting.boost(ready, 3, rounds=4, rate=0.3)
    steps = [boosting.deviance(boosting.Boosted(model.first, 0.3, model.rounds[:n]).transform(ready)) for n in range(5)]
    assert all(a > b for a, b in zip(steps, steps[1:], strict=False))
    out = model.transform(ready).select("label_idx", "prediction").collect()
    assert np.mean([r[0] == r[1] for r in out]) > 0.6


def test_absent_classes_unknown_labels_and_nothing(spark):
    _, _, df = table(spark, 60, 3, ("a", "c", "other"))
    out = models.predictions(df, df, "gradient_boosting", CLASSES, sizes={"rounds": 2}).collect()
    assert len(out) == 60 and {r["y_pred_label"] for r in out} <= {"a", "c"}
    with pytest.raises(ValueError, match="no rows"):
        boosting.boost(models._ready(df.where("label = 'other'"), CLASSES), 3)
