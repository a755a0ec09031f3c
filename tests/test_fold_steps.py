"""Steps of folds leave the rows where they are, and a row's length is summed once."""

import numpy as np

from callgrid.operators import fitted, prep


def test_a_fold_is_not_one_task(spark):
    """Before, statistics too large for Spark's own broadcast were joined by shuffle, so each fold was one task."""
    x = spark.range(400).selectExpr("id", "'a' AS label", "array(CAST(id AS DOUBLE), CAST(id * 7 % 13 AS DOUBLE)) AS features").repartition(4)
    table = fitted.one_fold(x.where("id % 4 > 0"), x.where("id % 4 = 0"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = fitted.scale(fitted.impute(table, "mean"), "robust_l2").selectExpr("spark_partition_id() AS part", "features").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(out) == 400 and len({r["part"] for r in out}) > 1


def test_length_is_summed_once(spark, capsys):
    x = np.random.default_rng(0).standard_normal((20, 6))
    x[3] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    out = rows.select("id", prep.l2_normalised(rows["features"]).alias("u"))
    got = np.array([r["u"] for r in out.orderBy("id").collect()])
    n = np.linalg.norm(x, axis=1)[:, None]
    assert np.allclose(got, np.where(n > 0, x / np.where(n > 0, n, 1), x), atol=1e-15)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1  # before, twice inside the lambda, so once or twice for every component
