"""Preprocessing steps fitted per fold, for all folds in one plan.

A table of copies has a row for each fold a row takes part in: once as test row of its own fold, and as train row of
every other. Every statistic is an aggregation of the train rows by (fold, position); it comes back as a small table with
an array per fold, joined by fold, so nothing is fitted on test rows and no step loops over folds. A plain fit of a train
table and a test table is the case of one fold.

Defined results: null and non-finite components are imputed first. A fold without train rows has no statistics, and its
rows are left out by the joins. Scales of zero count as one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callgrid.functions.scalars import finite_or
from callgrid.operators import information, nca, order_stats, prep

QUANTILES, NORMAL_KNOTS = 101, 1001
SCALERS = ("none", "standard", "robust", "minmax", "l2", "standard_l2", "robust_l2", "quantile_uniform", "quantile_normal", "power")
REDUCERS = ("none", "variance", "kbest", "pca", "nca")


def copies(rows: DataFrame, fold: str = "fold", within: str | None = None) -> DataFrame:
    """(fold, is_test, ...): each row as test row of its fold and as train row of every other fold that occurs, or that
    occurs in its group ``within``."""
    folds = rows.groupBy(*([within] if within else [])).agg(F.array_sort(F.collect_set(fold)).alias("__folds"))  # an entry per fold
    out = rows.join(folds, within) if within else rows.crossJoin(F.broadcast(folds))  # without groups, a single row
    out = out.withColumn("__of", F.explode("__folds"))
    return out.withColumn("is_test", F.col(fold) == F.col("__of")).drop(fold, "__folds").withColumnRenamed("__of", "fold")


def one_fold(train: DataFrame, test: DataFrame) -> DataFrame:
    part = lambda t, is_test: t.withColumns({"fold": F.lit(0), "is_test": F.lit(is_test)})
    return part(train, False).unionByName(part(test, True), allowMissingColumns=True)


def _train(table: DataFrame) -> DataFrame:
    return table.where("NOT is_test")


def _cells(table: DataFrame) -> DataFrame:
    """(fold, label, pos, x) of the train rows; null and non-finite components are null."""
    c = _train(table).select("fold", "label", F.posexplode("features").alias("pos", "x"))
    return c.withColumn("x", finite_or(F.col("x").cast("double"), F.lit(None)))


def _arrays(stats: DataFrame, **columns) -> DataFrame:
    """(fold, an array over positions for each column) from rows by (fold, pos)."""
    packed = stats.select("fold", F.struct("pos", *[c.alias(n) for n,
        c in columns.items()]).alias("s")).groupBy("fold").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return packed.select("fold", *[F.col(f"s.{n}").alias(f"__{n}") for n in columns])


def _with(table: DataFrame, arrays: DataFrame, features: Column) -> DataFrame:
    """The table with new features made of its own and of its fold's arrays. These are a row a fold, and broadcast: a join
    by shuffle would bring all rows of a fold into one task."""
    columns = table.columns
    return table.join(F.broadcast(arrays), "fold").withColumn("features", features).select(*columns)


def impute(table: DataFrame, by: str) -> DataFrame:
    if by not in ("mean", "median"):
        raise ValueError(f"unknown imputer {by!r}; known: mean, median")
    own, keys = _cells(table), ["fold", "pos"]
    if by == "mean":
        stats = own.groupBy(*keys).agg(F.avg("x").alias("fill"))
    else:
        stats = order_stats.quantiles(own, keys, [0.5]).withColumn("fill", F.get("q", F.lit(0)))
    stats = stats.withColumn("fill", F.coalesce("fill", F.lit(0.0)))
    return _with(table, _arrays(stats, fill=F.col("fill")), F.transform("features", lambda x, i: finite_or(x.cast("double"), F.get("__fill", i))))


def _moved(table: DataFrame, shift: Column, size: Column) -> DataFrame:
    return _moved_by(table, _cells(table).groupBy("fold", "pos").agg(shift.alias("shift"), size.alias("size")))


def _moved_by(table: DataFrame, stats: DataFrame) -> DataFrame:
    """Features less ``shift``, over ``size``, of their fold and position."""
    safe = F.when(F.col("size") > 0, F.col("size")).otherwise(F.lit(1.0))
    return _with(table, _arrays(stats, shift=F.col("shift"), size=safe), F.transform("features", lambda x, i: (x - F.get("__shift", i)) / F.get("__size", i)))


def _quantile(table: DataFrame, normal: bool) -> DataFrame:
    """Rank of each component among its fold's training quantiles; ``normal``: as a standard normal value."""
    at = np.linspace(0, 1, QUANTILES).tolist()
    stats = order_stats.quantiles(_cells(table), ["fold", "pos"], at)
    out = _with(table, _arrays(stats, knots=F.col("q")), F.transform("features", lambda x, i: prep.knot_rank(x, F.get("__knots", i))))
    if not normal:
        return out
    grid = np.linspace(0, 1, NORMAL_KNOTS)
    values = F.lit(prep.normal_quantile(grid).tolist())  # a fixed table, read with linear interpolation
    step = lambda u: u * (NORMAL_KNOTS - 1)
    low = lambda u: F.least(F.floor(step(u)), F.lit(NORMAL_KNOTS - 2)).cast("int")
    return out.withColumn("features", F.transform("features", lambda u: F.get(values, low(u)) + (step(u) - low(u)) * (F.get(values, low(u)
        + 1) - F.get(values, low(u)))))


def _power(table: DataFrame) -> DataFrame:
    """Yeo-Johnson with the exponent of each position by maximum likelihood, then standardised."""
    lambdas = prep.power_exponents(_cells(table), ["fold", "pos"])
    out = _with(table, _arrays(lambdas, power=F.col("lambda")), F.transform("features", lambda x, i: prep.yeo_johnson_column(x, F.get("__power", i))))
    return _moved(out, F.avg("x"), F.stddev_pop("x"))


def scale(table: DataFrame, kind: str) -> DataFrame:
    if kind not in SCALERS:
        raise ValueError(f"unknown scaler {kind!r}; known: {', '.join(SCALERS)}")
    first, _, then = kind.partition("_l2")
    if first == "standard":
        table = _moved(table, F.avg("x"), F.stddev_pop("x"))
    elif first == "robust":
        q = order_stats.quantiles(_cells(table), ["fold", "pos"], (0.25, 0.5, 0.75))
        table = _moved_by(table, q.select("fold", "pos", F.col("q")[1].alias("shift"), (F.col("q")[2] - F.col("q")[0]).alias("size")))
    elif first == "minmax":
        table = _moved(table, F.min("x"), F.max("x") - F.min("x"))
    elif first.startswith("quantile"):
        table = _quantile(table, first == "quantile_normal")
    elif first == "power":
        table = _power(table)
    if kind.endswith("l2"):
        table = table.withColumn("features", prep.l2_normalised(F.col("features")))
    return table


def _selected(table: DataFrame, kept: DataFrame) -> DataFrame:
    """Features at the kept (fold, pos) only, in order."""
    positions = kept.groupBy("fold").agg(F.array_sort(F.collect_list("pos")).alias("__kept"))
    return _with(table, positions, F.transform("__kept", lambda i: F.get("features", i)))


def _projected(table: DataFrame, components: dict, mean: dict) -> DataFrame:
    """Centred features on each fold's components, from the driver: folds x components x positions numbers."""
    spark = table.sparkSession
    rows = [(int(f), [[float(v) for v in c] for c in components[f]], [float(v) for v in mean[f]]) for f in components]
    arrays = spark.createDataFrame(rows, "fold int, __axes array<array<double>>, __mean array<double>").withColumn("fold",
        F.col("fold").cast(table.schema["fold"].dataType))
    centred = F.zip_with("features", "__mean", lambda x, m: x - m)
    dot = lambda axis: F.aggregate(F.zip_with(centred, axis, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return _with(table, arrays, F.transform("__axes", dot))


def reduce(table: DataFrame, kind: str, seed: int = 0) -> DataFrame:
    """none, variance[:threshold], kbest:k, pca:k, pca:share, nca:k."""
    name, _, value = str(kind).partition(":")
    if name not in REDUCERS:
        raise ValueError(f"unknown reducer {kind!r}; known: {', '.join(REDUCERS)}")
    if name == "none":
        return table
    if name == "variance":
        stats = _cells(table).groupBy("fold", "pos").agg(F.var_pop("x").alias("v"))
        return _selected(table, stats.where(F.col("v") > float(value or 0)))
    if name == "kbest":
        scored = information.mutual_information_scores(_cells(table), ["fold", "pos"], seed)
        rank = F.row_number().over(W.partitionBy("fold").orderBy(F.desc(F.round("score", 9)), "pos"))
        return _selected(table, scored.where(F.col("score").isNotNull()).withColumn("n", rank).where(F.col("n") <= max(1, int(value))))
    stats, found, means = _cells(table).groupBy("fold", "pos").agg(F.avg("x").alias("mean")), {}, {}
    for r in stats.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("s")).collect():  # folds x positions
        means[r["fold"]] = np.array([x["mean"] for x in r["s"]])
    if name == "nca":
        axes = nca.neighbourhood_components(_train(table), means, int(value), seed)
        return _projected(table, axes, means)
    n = float(value)
    for f, covariance in prep.covariances(_train(table), means).items():
        found[f], _ = prep.principal_components(covariance, **({"variance": n} if n < 1 else {"k": int(n)}))
    return _projected(table, found, means)


def transformed(table: DataFrame, imputer: str = "mean", scaler: str = "none", reducer: str = "none", seed: int = 0) -> DataFrame:
    """Copies through impute, scale and reduce."""
    return reduce(scale(impute(table, imputer), scaler), reducer, seed)
