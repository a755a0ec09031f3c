"""Minimal cost-complexity pruning of a Spark tree: the weakest-link path over its nodes, and the best subtree on
selection rows.

The tree is fitted once. Its nodes, which Spark's own model keeps on the driver, give the path; a pruned tree is an array
of predictions by leaf of the full one, so one pass over the selection rows judges all trials at once, and rows are
predicted by a leaf's number. Leaves grow with the rows, so these arrays are tables that are joined by leaf, not literals
of a plan. Thresholds are Spark's: of ``bins`` candidates a feature, not of every value.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrid.runtime import remove, stage, staged_path

#: Trials at most; of a longer path, quantiles of its alphas.
TRIALS = 12


@dataclass
class Nodes:
    """A tree's nodes by number, the root first: children (-1: a leaf), cost (its share of all rows' weight times impurity)
    and prediction."""

    left: np.ndarray
    right: np.ndarray
    cost: np.ndarray
    prediction: np.ndarray

    def leaves(self, kept: np.ndarray) -> tuple[int, int]:
        """(depth, leaves) of the tree without what lies below nodes that are not ``kept`` as inner ones."""
        depth, count, todo = 0, 0, [(0, 0)]
        left, right, kept = self.left.tolist(), self.right.tolist(), kept.tolist()
        while todo:
            n, at = todo.pop()
            if kept[n]:
                todo += [(left[n], at + 1), (right[n], at + 1)]
            else:
                depth, count = max(depth, at), count + 1
        return depth, count


def nodes_of(model) -> Nodes:
    """The nodes of a fitted tree model, from its saved table."""
    spark = SparkSession.getActiveSession()
    path = staged_path(spark, "tree")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data")
    rows = (rows.select("nodeData.*") if "nodeData" in rows.columns else rows).select("id", "prediction", "impurity", "impurityStats", "leftChild", "rightChild")
    found = rows.toArrow().sort_by("id")
    remove(spark, path)
    of = {name: found[name].to_numpy() for name in ("id", "prediction", "impurity", "leftChild", "rightChild")}
    number = {n: i for i, n in enumerate(of["id"].tolist())}
    weight = np.array([sum(r) for r in found["impurityStats"].to_pylist()])
    at = lambda name: np.array([number.get(n, -1) for n in of[name].tolist()])
    return Nodes(at("leftChild"), at("rightChild"), weight / (weight[0] or 1.0) * of["impurity"], of["prediction"])


def cuts(tree: Nodes) -> tuple[np.ndarray, np.ndarray]:
    """(alphas, gone): the ascending alphas of the path from the full tree, alpha 0, to the root alone, and for each node the
    first of them, by its number, with which it is no inner one. The nodes with ``gone`` above i stay inner ones at the i-th.

    Each step cuts the inner node whose subtree saves least cost a leaf (ties: the first), and mends its ancestors only. The
    candidates are a heap, in which a node's older figures stay until they come up, so work is about that of all ancestors."""
    n = len(tree.left)
    left, right, own = tree.left.tolist(), tree.right.tolist(), tree.cost.tolist()
    kept, parent = (tree.left >= 0).tolist(), np.full(n, -1)
    for side in (tree.left, tree.right):
        parent[side[side >= 0]] = np.flatnonzero(side >= 0)
    parent, order, todo = parent.tolist(), [], [0]
    while todo:
        at = todo.pop()
        order.append(at)
        todo += [c for c in (left[at], right[at]) if c >= 0]
    cost, count = own.copy(), [1] * n
    for at in reversed(order):  # children first
        if kept[at]:
            cost[at], count[at] = cost[left[at]] + cost[right[at]], count[left[at]] + count[right[at]]
    alphas, gone, alpha = [0.0], [0] * n, 0.0
    link = [(own[i] - cost[i]) / (count[i] - 1) if kept[i] else np.inf for i in range(n)]
    heap = [(link[i], i) for i in range(n) if kept[i]]
    heapq.heapify(heap)
    while kept[0]:
        weakest, at = heapq.heappop(heap)
        if not kept[at] or weakest != link[at]:
            continue
        alpha = max(alpha, weakest)
        if alpha > alphas[-1] + 1e-15:  # else as weak as the last: cut together with it
            alphas.append(alpha)
        saved, fewer, below = own[at] - cost[at], count[at] - 1, [at]
        while below:
            x = below.pop()
            if kept[x]:
                kept[x], link[x], gone[x] = False, np.inf, len(alphas) - 1
                below += [left[x], right[x]]
        cost[at], count[at], up = own[at], 1, parent[at]
        while up >= 0:
            cost[up], count[up] = cost[up] + saved, count[up] - fewer
            link[up] = (own[up] - cost[up]) / (count[up] - 1)
            heapq.heappush(heap, (link[up], up))
            up = parent[up]
    return np.array(alphas), np.array(gone)


def path(tree: Nodes) -> list[tuple[float, np.ndarray]]:
    """(alpha, which nodes stay inner ones) of every step, for small trees: an array of all nodes each."""
    alphas, gone = cuts(tree)
    return [(alpha, gone > i) for i, alpha in enumerate(alphas.tolist())]


def trial_alphas(alphas: list[float], most: int = TRIALS) -> list[float]:
    found = np.unique(alphas)
    return (found if len(found) <= most else np.unique(np.quantile(found, np.linspace(0, 1, most)))).tolist()


def by_leaf(tree: Nodes, kept: np.ndarray) -> list[float]:
    """The pruned tree's prediction for each leaf of the full one, leaves from left to right."""
    out, todo = [], [(0, None)]
    left, right, prediction, kept = tree.left.tolist(), tree.right.tolist(), tree.prediction.tolist(), kept.tolist()
    while todo:
        at, cut = todo.pop()
        cut = at if cut is None and not kept[at] else cut
        if left[at] < 0:
            out.append(float(prediction[cut]))
        else:
            todo += [(right[at], cut), (left[at], cut)]
    return out


def leaf_table(spark: SparkSession, predictions: list[list[float]]) -> DataFrame:
    """(__leaf, __p), staged: the predictions of one tree or several for each leaf."""
    each = np.array(predictions, dtype=float).T
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1) * each.shape[1], pa.int32()), pa.array(each.ravel()))
    made = spark.createDataFrame(pa.table({"__leaf": pa.array(np.arange(len(each)), pa.int32()), "__p": lists}))
    return stage(made, "tree-leaves")


@dataclass
class Pruned:
    """A full tree's model with the predictions of its subtree."""

    model: object
    predictions: list[float]
    alpha: float

    def transform(self, rows: DataFrame) -> DataFrame:
        placed = self.model.setLeafCol("__leaf").transform(rows).withColumn("__leaf", F.col("__leaf").cast("int")).drop("prediction")
        joined = placed.join(leaf_table(rows.sparkSession, [self.predictions]), "__leaf")
        return joined.withColumn("prediction", F.col("__p")[0]).drop("__leaf", "__p")


def cost_complexity_tree(train: DataFrame, selection: DataFrame, classes, seed: int = 0, depth: int = 30, most: int = TRIALS) -> tuple[Pruned, list[tuple]]:
    """(model, trials) from (id, label, features) tables: the subtree with the best macro-F1 on the selection rows; ties to
    the shallower, the one with fewer leaves, the smaller alpha. trials: (alpha, score, depth, leaves) of each."""
    from pyspark.ml.classification import DecisionTreeClassifier

    from callgrid.operators.metrics import metrics
    from callgrid.operators.models import _ready, balanced

    fitted = DecisionTreeClassifier(maxDepth=depth, seed=seed, featuresCol="vector", labelCol="label_idx", predictionCol="prediction", weightCol="weight")
    model = fitted.fit(balanced(_ready(train, classes)))
    tree = nodes_of(model)
    alphas, gone = cuts(tree)
    trials = []
    for alpha in trial_alphas(alphas.tolist(), most):
        kept = gone > np.searchsorted(alphas, alpha, "right") - 1
        trials.append((alpha, by_leaf(tree, kept), *tree.leaves(kept)))
    name = F.array(*[F.lit(c) for c in classes])
    leaves = model.setLeafCol("__leaf").transform(_ready(selection, classes)).select("label", F.col("__leaf").cast("int").alias("__leaf"))
    every = leaves.join(leaf_table(leaves.sparkSession, [t[1] for t in trials]), "__leaf").select("label", F.posexplode("__p").alias("trial", "p"))
    judged = every.select("trial", F.col("label").alias("y_true_label"), F.get(name, F.col("p").cast("int")).alias("y_pred_label"))
    score = {r["trial"]: r["macro_f1"] for r in metrics(judged, classes, ["trial"]).collect()}
    found = [(alpha, score.get(i) or 0.0, depth, count) for i, (alpha, _, depth, count) in enumerate(trials)]
    best = min(range(len(found)), key=lambda i: (-found[i][1], found[i][2], found[i][3], found[i][0]))
    return Pruned(model, trials[best][1], found[best][0]), found
