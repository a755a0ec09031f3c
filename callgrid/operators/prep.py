"""Preprocessing as fitted statistics. Fitting is one aggregation over (position, value) rows of the training part; the
result, one row per position, is applied to whole vectors by array functions, so rows are not taken apart to transform.

Statistics are exact: population deviations, exact quantiles with linear interpolation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callgrid.functions.scalars import finite_or
from callgrid.operators import information, order_stats


def cells(rows: DataFrame, features: str = "features") -> DataFrame:
    """(pos, x) of all components; null and non-finite ones are null."""
    return rows.select(F.posexplode(features).alias("pos", "x")).select("pos", finite_or(F.col("x").cast("double"), F.lit(None)).alias("x"))


QUARTILES = (0.25, 0.5, 0.75)


def statistics(rows: DataFrame, features: str = "features", quantiles=QUARTILES) -> DataFrame:
    """(pos, n, mean, std, min, max, q): q the exact quantiles; without them one aggregation is all."""
    own = cells(rows, features)
    plain = own.groupBy("pos").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    return plain if quantiles is None else plain.join(order_stats.quantiles(own, ["pos"], quantiles), "pos")


def fetched(stats: DataFrame) -> list:
    """The statistics on the driver: one row per vector position."""
    return stats.orderBy("pos").collect()


def _array(values) -> Column:
    return F.lit([float(v) if v is not None else 0.0 for v in values])


def _by_position(features: Column, fn) -> Column:
    return F.transform(features, fn)


def impute(features: Column, stats: list, by: str = "mean") -> Column:
    """Null and non-finite components become the training mean or median."""
    fill = _array([r["mean"] if by == "mean" else (r["q"] or [0, 0, 0])[1] for r in stats])
    return F.transform(features, lambda x, i: finite_or(x.cast("double"), F.get(fill, i)))


def scale(features: Column, stats: list, kind: str = "standard") -> Column:
    """standard, robust or minmax; a scale of zero counts as one."""
    if kind == "standard":
        shift, size = [r["mean"] for r in stats], [r["std"] for r in stats]
    elif kind == "robust":
        shift, size = [r["q"][1] for r in stats], [r["q"][2] - r["q"][0] for r in stats]
    elif kind == "minmax":
        shift, size = [r["min"] for r in stats], [r["max"] - r["min"] for r in stats]
    else:
        raise ValueError(f"unknown scaler {kind!r}")
    a, b = _array(shift), _array([s if s else 1.0 for s in size])
    return F.transform(features, lambda x, i: (x - F.get(a, i)) / F.get(b, i))


def l2_normalised(features: Column) -> Column:
    """Rows of length one; the zero vector stays."""
    norm = F.sqrt(F.aggregate(features, F.lit(0.0), lambda s, x: s + x * x))
    # The norm is an argument of the outer function: named inside the inner one, it would be summed again for every component.
    return F.get(F.transform(F.array(norm), lambda n: F.transform(features, lambda x: F.when(n > 0, x / n).otherwise(x))), F.lit(0))


def variance_kept(stats: list, threshold: float = 0.0) -> list[int]:
    """Positions whose population variance is above the threshold."""
    return [r["pos"] for r in stats if (r["std"] or 0.0) ** 2 > threshold]


def selected(features: Column, positions) -> Column:
    return F.transform(F.lit([int(p) for p in positions]), lambda i: F.get(features, i))


def quantile_knots(rows: DataFrame, n: int = 101, features: str = "features") -> DataFrame:
    return statistics(rows, features, np.linspace(0, 1, n).tolist()).select("pos", F.col("q").alias("knots"))


def knot_rank(x: Column, knots: Column) -> Column:
    """Rank in [0, 1] of a value among sorted quantiles: linear between two, the middle of those it equals."""
    n = F.size(knots) - 1
    below, upto = F.size(F.filter(knots, lambda k: k < x)), F.size(F.filter(knots, lambda k: k <= x))
    lo, hi = F.get(knots, below - 1), F.get(knots, below)
    between = (below - 1 + (x - lo) / (hi - lo)) / n
    tie = (below + upto - 1) / 2 / n
    return F.when(x <= F.get(knots, F.lit(0)), F.lit(0.0)).when(x >= F.get(knots, n), F.lit(1.0)).when(upto > below, tie).otherwise(between)


def quantile_uniform(rows: DataFrame, knots: DataFrame, features: str = "features", id_column: str = "id") -> DataFrame:
    """(id, pos, x, u): rank of each component on the training quantiles.

    Works on (position, value) rows joined to one row per position.
    """
    c = rows.select(id_column, F.posexplode(features).alias("pos", "x")).join(knots, "pos")
    return c.select(id_column, "pos", "x", knot_rank(F.col("x"), F.col("knots")).alias("u"))


def normal_quantile(u: np.ndarray) -> np.ndarray:
    """Inverse normal distribution by Newton steps on the error function."""
    from math import erf, exp, pi, sqrt

    out = []
    for p in np.clip(u, 1e-7, 1 - 1e-7):
        x = 0.0
        for _ in range(60):
            step = (0.5 * (1 + erf(x / sqrt(2))) - p) / (exp(-x * x / 2) / sqrt(2 * pi) + 1e-300)
            x -= float(np.clip(step, -1, 1))
            if abs(step) < 1e-12:
                break
        out.append(x)
    return np.array(out)


def yeo_johnson(x: np.ndarray, lam: float) -> np.ndarray:
    pos, out = x >= 0, np.empty_like(x, float)
    out[pos] = np.log1p(x[pos]) if abs(lam) < 1e-12 else ((x[pos] + 1) ** lam - 1) / lam
    out[~pos] = -np.log1p(-x[~pos]) if abs(lam - 2) < 1e-12 else -((1 - x[~pos]) ** (2 - lam) - 1) / (2 - lam)
    return out


def yeo_johnson_lambda(x: np.ndarray) -> float:
    """Maximum-likelihood exponent by golden-section search."""
    if np.ptp(x) == 0:
        return 1.0

    def loss(lam):
        y = yeo_johnson(x, lam)
        return 0.5 * len(x) * np.log(max(y.var(), 1e-300)) - (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

    a, b, g = -4.0, 6.0, (5**0.5 - 1) / 2
    for _ in range(80):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return (a + b) / 2


def yeo_johnson_column(x: Column, lam: Column) -> Column:
    up = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    down = F.when(F.abs(lam - 2) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, up).otherwise(down)


def power_exponents(values: DataFrame, keys: list[str], low: float = -4.0, high: float = 6.0, rounds: int = 5, points: int = 11) -> DataFrame:
    """(keys, lambda): the maximum-likelihood exponent of x by keys, found on grids that narrow around the best point.

    A round is one aggregation of sums for ``points`` exponents; no task holds a column. The exponent is within
    (high - low) * (2 / (points - 1)) ** rounds of the best, 0.003 by default. Constant columns have 1.
    """
    from callgrid.runtime import stage

    values = stage(values.where("x IS NOT NULL"), "power-values")
    best = values.groupBy(*keys).agg(F.lit(low).alias("a"), F.lit(high).alias("b"), (F.max("x") > F.min("x")).alias("varied"))
    for _ in range(rounds):
        step = (F.col("b") - F.col("a")) / (points - 1)
        grid = best.where("varied").select(*keys, step.alias("step"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("a")
            + i * step)).alias("lam"))
        tried = values.join(grid, keys).withColumn("y", yeo_johnson_column(F.col("x"), F.col("lam")))
        sums = tried.groupBy(*keys, "lam", "step").agg(F.var_pop("y").alias("v"), F.sum(F.signum("x") * F.log1p(F.abs("x"))).alias("s"),
            F.count("*").alias("n"))
        loss = 0.5 * F.col("n") * F.log(F.greatest("v", F.lit(1e-300))) - (F.col("lam") - 1) * F.col("s")
        won = sums.groupBy(*keys).agg(F.min_by(F.struct("lam", "step"), F.struct(F.round(loss, 9), "lam")).alias("w"))
        won = won.select(*keys, (F.col("w.lam") - F.col("w.step")).alias("a"), (F.col("w.lam") + F.col("w.step")).alias("b"), F.lit(True).alias("varied"))
        best = stage(won.unionByName(best.where("NOT varied")), "power-grid")
    return best.select(*keys, F.when(F.col("varied"), (F.col("a") + F.col("b")) / 2).otherwise(F.lit(1.0)).alias("lambda"))


def power_lambdas(rows: DataFrame, features: str = "features") -> DataFrame:
    """(pos, lambda) of every position."""
    return power_exponents(cells(rows, features), ["pos"])


def covariances(rows: DataFrame, means: dict, by: str = "fold", features: str = "features") -> dict:
    """Population covariance by fold, summed from per-batch matrices; a matrix per partition and fold leaves the tasks."""

    def partial(batches):
        import pyarrow as pa

        total: dict = {}
        for b in batches:
            fold, flat = b.column(0).to_numpy(zero_copy_only=False), b.column(1).flatten().to_numpy(zero_copy_only=False)
            x = flat.astype(float).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1))
            for f in np.unique(fold).tolist():
                y = x[fold == f] - means[f]
                s, n = total.get(f, (0.0, 0))
                total[f] = s + y.T @ y, n + len(y)
        for f, (s, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([n], pa.int64()), pa.array([s.ravel().tolist()],
                pa.list_(pa.float64()))], names=["fold", "n", "s"])

    parts = rows.select(F.col(by).cast("int"), features).mapInArrow(partial, "fold int, n long, s array<double>")
    summed = parts.select("fold", "n", F.posexplode("s").alias("at", "v")).groupBy("fold", "at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    whole = summed.groupBy("fold").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "v"))).alias("s")).collect()
    return {r["fold"]: np.array([c["v"] for c in r["s"]]).reshape(len(means[r["fold"]]), -1) / max(1, r["n"]) for r in whole}


def covariance(rows: DataFrame, stats: list, features: str = "features") -> np.ndarray:
    """Population covariance, summed from per-batch matrices; one matrix per partition reaches the driver."""
    mean, d = np.array([r["mean"] for r in stats]), len(stats)

    def partial(batches):
        import pyarrow as pa

        total, n = np.zeros((d, d)), 0
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float).reshape(-1, d) - mean
            total, n = total + x.T @ x, n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "s"])

    parts = rows.select(features).mapInArrow(partial, "n long, s array<double>")
    summed = parts.select("n", F.posexplode("s").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("at").collect()
    return np.array([r["v"] for r in summed]).reshape(d, d) / max(1, summed[0]["n"])


def principal_components(cov: np.ndarray, k: int | None = None, variance: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(components as rows, explained shares). k is clamped; or the smallest k that reaches a share of the variance.
    Signs are fixed so that each component's largest entry is positive."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    values, vectors = np.maximum(values[order], 0), vectors[:, order].T
    share = values / max(values.sum(), 1e-300)
    if variance is not None:
        k = int(np.searchsorted(np.cumsum(share), variance - 1e-12) + 1)
    k = max(1, min(k or len(values), len(values)))
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]
    return vectors[:k], share[:k]


def projected(features: Column, stats: list, components: np.ndarray) -> Column:
    """Centred vectors on the components, by array functions."""
    mean = _array([r["mean"] for r in stats])
    centred = F.zip_with(features, mean, lambda x, m: x - m)
    dot = lambda c: F.aggregate(F.zip_with(centred, _array(c), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return F.array(*[dot(c) for c in components])


def digamma(n: int) -> float:
    return -0.5772156649015329 + sum(1 / i for i in range(1, n)) if n < 50 else float(np.log(n) - 1 / (2 * n) - 1 / (12 * n * n))


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3, seed: int = 0) -> float:
    """Of one column in memory, against which ``information`` is held: nearest-neighbour estimate between a continuous
    and a discrete variable (Ross 2014), with seeded tiny noise:
    psi(N) + mean of psi(k) - psi(rows of the label) - psi(rows within the k-th distance), over labels of two rows or more."""
    x = x / (x.std() or 1.0)
    x = x + 1e-10 * max(1.0, np.abs(x).mean()) * np.random.Generator(np.random.PCG64(seed)).standard_normal(len(x))
    used, total, whole = 0, 0.0, np.sort(x)
    for c in np.unique(y):
        own = np.sort(x[y == c])
        if len(own) < 2:
            continue
        kk = min(k, len(own) - 1)
        # the k nearest in a sorted column lie in a window of k on either side
        around = np.stack([np.abs(own - np.concatenate([np.full(max(0, o), np.inf), own, np.full(max(0, -o), np.inf)])[max(0, -o) : max(0, -o)
            + len(own)]) for o in range(-kk, kk + 1) if o])
        radius = np.nextafter(np.partition(around, kk - 1, axis=0)[kk - 1], 0)
        low, high = np.searchsorted(whole, own - radius, "left"), np.searchsorted(whole, own + radius, "right")
        for ends, at, out in ((low, 0, 1), (high, -1, -1)):  # sums round: a border row is in by its own difference
            while (far := (low < high) & (np.abs(whole[np.clip(ends + at, 0, len(whole) - 1)] - own) > radius)).any():
                ends += out * far
            while (near := (ends + at - out >= 0) & (ends + at - out < len(whole)) & (np.abs(whole[np.clip(ends + at - out, 0,
                len(whole) - 1)] - own) <= radius)).any():
                ends -= out * near
        total += sum(digamma(kk) - digamma(len(own)) - digamma(max(1, int(m))) for m in high - low)
        used += len(own)
    return max(0.0, digamma(used) + total / used) if used else 0.0


def select_k_best(rows: DataFrame, k: int, label: str = "label", features: str = "features", seed: int = 0) -> DataFrame:
    """(pos, score, selected): k is clamped to the number of positions."""
    values = rows.select(F.col(label).alias("label"), F.posexplode(features).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    scored = information.mutual_information_scores(values, ["pos"], seed)
    return scored.withColumn("selected", F.row_number().over(W.orderBy(F.desc(F.round("score", 9)), "pos")) <= max(1, k))
