"""Multinomial gradient boosting: in each round one regression tree a class on the softmax residuals, with Newton leaf values.

The rows keep their raw scores, an array over classes. A round fits Spark's regression trees on the residuals of the staged
rows, sums residuals and curvatures of all trees' leaves in one aggregation, and stages the rows with new scores; the last
round's table goes then. What reaches the driver is a number for each leaf.

Defined results: rows of a label that is no class are left out of the fit. A class without rows gets the least score and
no tree of its own moves it. Two classes are two trees a round. No rows to fit on is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrid.runtime import remove, stage, staged_path

#: Least share of a class in the first scores, and rounds after which predictions are staged, so that no plan grows long.
LEAST_SHARE, ROUNDS_A_PLAN = 1e-7, 10


def shares(raw: Column) -> Column:
    """Softmax of an array."""
    top = F.array_max(raw)
    e = F.transform(raw, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, v: s + v))


def moved(raw: Column, leaves: list[Column], values: list[list[float]], rate: float) -> Column:
    """Scores after a round: each class by its tree's value of the row's leaf."""
    return F.array(*[raw[c] + rate * F.get(F.lit(v), leaf.cast("int")) for c, (leaf, v) in enumerate(zip(leaves, values, strict=True))])


@dataclass
class Boosted:
    """First scores, and for each round its trees and the values of their leaves."""

    first: list[float]
    rate: float
    rounds: list[tuple[list, list[list[float]]]] = field(default_factory=list)

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows with ``raw`` and ``prediction``; ties go to the class declared first."""
        names, out = rows.columns, rows.withColumn("raw", F.lit(self.first))
        for n, (trees, values) in enumerate(self.rounds, 1):
            out = _with_leaves(out, trees)
            out = out.withColumn("raw", moved(F.col("raw"), _leaves(trees), values, self.rate)).select(*names, "raw")
            if n % ROUNDS_A_PLAN == 0:
                out = stage(out, "boosting-scores")
        return out.withColumn("prediction", (F.array_position("raw", F.array_max("raw")) - 1).cast("double"))


def _with_leaves(rows: DataFrame, trees: list) -> DataFrame:
    for c, tree in enumerate(trees):
        rows = tree.setLeafCol(f"__leaf{c}").setPredictionCol(f"__value{c}").transform(rows)
    return rows


def _leaves(trees: list) -> list[Column]:
    return [F.col(f"__leaf{c}") for c in range(len(trees))]


def deviance(rows: DataFrame, raw: str = "raw") -> float:
    """Mean negative log share of the rows' own classes."""
    own = F.get(shares(F.col(raw)), F.col("label_idx").cast("int"))
    return rows.agg(F.avg(-F.log(own))).first()[0]


def boost(ready: DataFrame, n_classes: int, rounds: int = 100, depth: int = 3, rate: float = 0.1, seed: int = 0) -> Boosted:
    """Fitted on (label_idx, vector)."""
    from pyspark.ml.regression import DecisionTreeRegressor

    spark, known = ready.sparkSession, ready.where(F.col("label_idx").between(0, n_classes - 1)).select("label_idx", "vector")
    counts = {int(r["label_idx"]): r["count"] for r in known.groupBy("label_idx").count().collect()}
    total = sum(counts.values())
    if not total:
        raise ValueError("no rows to fit on")
    model = Boosted([float(np.log(max(counts.get(c, 0) / total, LEAST_SHARE))) for c in range(n_classes)], rate)
    held = staged_path(spark, "boosting")
    rows = stage(known.withColumn("raw", F.lit(model.first)), "boosting", held)
    for n in range(rounds):
        share = shares(F.col("raw"))
        residuals = F.transform(share, lambda p, c: (F.col("label_idx") == c).cast("double") - p)
        now = rows.withColumn("residuals", residuals)
        trees = []
        for c in range(n_classes):
            tree = DecisionTreeRegressor(maxDepth=depth, seed=seed + n, featuresCol="vector", labelCol="residual")
            trees.append(tree.fit(now.select("vector", F.col("residuals")[c].alias("residual"))))
        placed = _with_leaves(now, trees)
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), leaf.cast("int").alias("leaf"), F.col("residuals")[c].alias("r"))
            for c, leaf in enumerate(_leaves(trees))]))
        size = F.abs("r")
        sums = placed.select(each.alias("e")).select("e.*").groupBy("c", "leaf").agg(F.sum("r").alias("r"), F.sum(size * (1 - size)).alias("h")).collect()
        values = [[0.0] * ((t.numNodes + 1) // 2) for t in trees]
        for s in sums:
            if s["h"] > 1e-150:
                values[s["c"]][s["leaf"]] = (n_classes - 1) / n_classes * s["r"] / s["h"]
        model.rounds.append((trees, values))
        path = staged_path(spark, "boosting")
        rows = stage(placed.withColumn("raw", moved(F.col("raw"), _leaves(trees), values, rate)).select("label_idx", "vector", "raw"), "boosting", path)
        remove(spark, held)
        held = path
    remove(spark, held)
    return model
