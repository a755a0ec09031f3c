"""Neighbourhood component analysis: axes that raise the expected accuracy of a stochastic nearest neighbour.

Every train row takes part. Rows of a fold fall into batches of about ``BATCH_ROWS`` by the hash of their id, and a row's
neighbours are those of its batch; up to that many rows, that is the whole fold. A batch is a row of a staged table, so a
round of ascent is one job without a shuffle of rows, for all folds at once: tasks sum hits and gradients of their batches
at the axes on trial, and axes alone reach the driver. A step that doesn't raise a fold's hits is halved.

Defined results: null is a label like others. A batch of a single row has no neighbours and counts nothing. Vectors are of
one length, without null components.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrid.operators import prep
from callgrid.runtime import by_value, remove, stage, staged_path

by_value(__name__)

BATCH_ROWS, LEAST_RATE = 1000, 1e-4


def hits(axes: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """(expected number of rows whose neighbour has their label, its gradient by the axes) within a batch."""
    if len(x) < 2:
        return 0.0, np.zeros_like(axes)
    z = x @ axes.T
    size = (z * z).sum(1)
    far = np.maximum(size[:, None] + size[None] - 2 * z @ z.T, 0)
    np.fill_diagonal(far, np.inf)
    p = np.exp(far.min(1, keepdims=True) - far)
    p /= p.sum(1, keepdims=True)
    same = y[:, None] == y[None]
    own = (p * same).sum(1)
    w = p * (own[:, None] - same)
    between = np.diag(w.sum(0) + w.sum(1)) - w - w.T
    return float(own.sum()), 2 * axes @ (x.T @ between @ x)


def batched(rows: DataFrame, seed: int = 0, size: int = BATCH_ROWS) -> DataFrame:
    """(fold, batch, labels, vectors): a row per batch of (id, fold, label, features)."""
    counts = rows.groupBy("fold").agg(F.ceil(F.count("*") / size).alias("__batches"))  # a row per fold
    batch = F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("__batches")).alias("batch")
    pair = F.struct(F.col("label").cast("string").alias("label"), F.col("features").cast("array<double>").alias("x"))
    placed = rows.join(counts, "fold").select(F.col("fold").cast("int").alias("fold"), batch, pair.alias("pair"))
    listed = placed.groupBy("fold", "batch").agg(F.collect_list("pair").alias("pairs"))
    return listed.select("fold", "batch", F.transform("pairs", lambda p: F.coalesce(p["label"], F.lit("\0"))).alias("labels"),
        F.transform("pairs", lambda p: p["x"]).alias("vectors"))


def total_hits(batches: DataFrame, axes: dict[int, np.ndarray], means: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
    """Hits and gradient of each fold that has axes, summed over its batches: one job."""

    def partial(parts):
        found: dict = {}
        for b in parts:
            for i in range(b.num_rows):
                fold, labels, vectors = b.column(0)[i].as_py(), b.column(1)[i].values, b.column(2)[i].values
                x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(labels), -1) - means[fold]
                n, g = hits(axes[fold], x, labels.to_numpy(zero_copy_only=False))
                found[fold] = found.get(fold, 0) + np.concatenate([[n], g.ravel()])
        for fold, s in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([s.tolist()], pa.list_(pa.float64()))], names=["fold", "s"])

    own = batches.where(F.col("fold").isin(list(axes))).select("fold", "labels", "vectors").mapInArrow(partial, "fold int, s array<double>")
    summed = own.select("fold", F.posexplode("s").alias("at", "v")).groupBy("fold", "at").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for fold, s in summed.sort_values("at").groupby("fold"):
        v = s["v"].to_numpy(float)
        out[int(fold)] = float(v[0]), v[1:].reshape(axes[int(fold)].shape)
    return out


@dataclass
class _Ascent:
    axes: np.ndarray
    rate: float
    hits: float
    gradient: np.ndarray

    def moved(self) -> np.ndarray:
        """The axes a step on; the largest change is ``rate`` of the largest entry."""
        return self.axes + self.rate * self.gradient / max(1e-12, float(np.abs(self.gradient).max())) * float(np.abs(self.axes).max())


def neighbourhood_components(rows: DataFrame, means: dict, k: int, seed: int = 0, size: int = BATCH_ROWS, rounds: int = 100,
    rate: float = 0.05) -> dict[int, np.ndarray]:
    """Axes by fold of (id, fold, label, features), by gradient ascent from the principal axes on."""
    first = {}
    for fold, covariance in prep.covariances(rows, means).items():
        axes = prep.principal_components(covariance, k)[0]
        first[fold] = axes / max(1e-12, float(np.sqrt(np.trace(axes @ covariance @ axes.T))))
    held = staged_path(rows.sparkSession, "nca-batches")
    batches = stage(batched(rows, seed, size), "nca-batches", held)
    folds = {f: _Ascent(first[f], rate, n, g) for f, (n, g) in total_hits(batches, first, means).items()}
    for _ in range(rounds):
        tried = {f: a.moved() for f, a in folds.items() if a.rate >= LEAST_RATE}
        if not tried:
            break
        for f, (n, g) in total_hits(batches, tried, means).items():
            if n > folds[f].hits:
                folds[f] = _Ascent(tried[f], folds[f].rate, n, g)
            else:
                folds[f].rate /= 2
    remove(rows.sparkSession, held)
    return {f: a.axes for f, a in folds.items()}
