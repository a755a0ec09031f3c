"""Support vector machines: weighted hinge loss with C, one machine for each pair of classes, linear or on kernel features.

Kernel features are Nystroem's: similarities to landmark rows, whitened by the landmarks' own kernel, so their inner
products are the kernel, exactly so where the landmarks are all rows. Landmarks are the rows with the smallest hash of
their id; a number of them that doesn't grow with the table is held by every task. Machines are Spark's linear ones; one
projection gives all margins of a row and counts their votes.

Defined results: pairs are made of the classes that have training rows; a table of one class predicts that. Vectors are of
one length, without null components.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrid.runtime import by_value, slices, stage

by_value(__name__)

LANDMARKS, LEAST_EIGENVALUE = 256, 1e-12


def scale_gamma(rows: DataFrame) -> float:
    """1 / (positions x variance of all components)."""
    cells = rows.select(F.size("features").alias("n"), F.explode("features").alias("x"))
    r = cells.agg(F.max("n").alias("n"), F.var_pop("x").alias("v")).first()
    return 1.0 / (r["n"] * r["v"]) if r["n"] and r["v"] else 1.0


def gaussian(x: np.ndarray, z: np.ndarray, gamma: float) -> np.ndarray:
    far = (x * x).sum(1)[:, None] + (z * z).sum(1)[None] - 2 * x @ z.T
    return np.exp(-gamma * np.maximum(far, 0))


@dataclass
class KernelMap:
    """Landmarks and the matrix that whitens similarities to them."""

    landmarks: np.ndarray
    whitening: np.ndarray
    gamma: float

    def features(self, x: np.ndarray) -> np.ndarray:
        return gaussian(x, self.landmarks, self.gamma) @ self.whitening

    def apply(self, rows: DataFrame) -> DataFrame:
        """The rows with kernel features in place of their own."""
        at = rows.columns.index("features")

        def run(batches):
            for b in slices(batches, 1024):
                x = np.array(b.column(at).to_pylist(), float).reshape(b.num_rows, -1)
                y = self.features(x) if b.num_rows else np.zeros((0, self.whitening.shape[1]))
                ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
                columns = [pa.ListArray.from_arrays(ends, pa.array(y.ravel())) if i == at else c for i, c in enumerate(b.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

        own = rows.withColumn("features", F.col("features").cast("array<double>"))
        return own.mapInArrow(run, own.schema)


def kernel_map(train: DataFrame, landmarks: int = LANDMARKS, gamma: float | None = None, seed: int = 0) -> KernelMap:
    gamma = scale_gamma(train) if gamma is None else gamma
    chosen = train.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(landmarks).select("features").collect()  # ``landmarks`` rows
    z = np.array([r["features"] for r in chosen], float)
    values, vectors = np.linalg.eigh(gaussian(z, z, gamma))
    return KernelMap(z, vectors / np.sqrt(np.maximum(values, LEAST_EIGENVALUE)) @ vectors.T, gamma)


@dataclass
class Machines:
    """(first class, second class, weights, intercept) of each pair; a positive margin is a vote for the first."""

    pairs: list[tuple[int, int, list[float], float]]
    only: int

    def margins(self):
        dot = lambda w: F.aggregate(F.zip_with("features", F.lit(w), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return [dot(w) + b for _, _, w, b in self.pairs]

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows with ``prediction``: the class with most votes, ties to the one declared first."""
        if not self.pairs:
            return rows.withColumn("prediction", F.lit(float(self.only)))
        classes = sorted({c for p in self.pairs for c in p[:2]})
        marked = rows.withColumn("__won", F.array(*[F.when(m > 0, a).otherwise(b) for m, (a, b, _, _) in zip(self.margins(), self.pairs, strict=True)]))
        won = lambda c: F.size(F.filter("__won", lambda x: x == c))
        votes = F.array(*[F.struct(won(c).alias("n"), F.lit(-c).alias("c")) for c in classes])
        return marked.withColumn("prediction", -F.array_max(votes)["c"].cast("double")).drop("__won")


def fit_machines(ready: DataFrame, c: float, iterations: int = 100) -> Machines:
    """Machines of rows (label_idx, features, weight): C times the weighted hinge loss plus half the squared norm."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    rows = stage(ready.where("label_idx IS NOT NULL").select("label_idx", "weight", "features", array_to_vector("features").alias("vector")), "machine-rows")
    weights = {int(r["label_idx"]): r["w"] for r in rows.groupBy("label_idx").agg(F.sum("weight").alias("w")).collect()}
    found = []
    for a, b in combinations(sorted(weights), 2):
        pair = rows.where(F.col("label_idx").isin(a, b)).withColumn("first", (F.col("label_idx") == a).cast("double"))
        machine = LinearSVC(maxIter=iterations, regParam=1 / (c * (weights[a] + weights[b])), standardization=False, weightCol="weight",
            featuresCol="vector", labelCol="first").fit(pair)
        found.append((a, b, [float(x) for x in machine.coefficients], float(machine.intercept)))
    return Machines(found, min(weights, default=0))
