"""A network with one hidden layer of rectified units, fitted by mini-batches whose gradients are summed by tasks.

Rows fall into batches by the hash of their id: batches of about 200 rows, or ``MOST_BATCHES`` equal ones of a larger table,
the same in every epoch. A step is one job over its batch: each task sums the gradients of its rows, Spark adds the sums,
and the driver, which holds nothing but weights, moves them by Adam's rule. A tenth of the rows, also by hash, is held out;
it is scored together with the first batch of the next epoch. The fit ends when that score stands still, and the weights of
the best epoch are kept.

Defined results: rows of a label that is no class are left out of the fit. A table so small that no row is held out runs
all epochs and keeps the last weights. No rows to fit on is an error. Vectors are of one length, without null components.
Ties of a prediction go to the class declared first.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrid.runtime import by_value, remove, slices, staged_path

by_value(__name__)

BATCH_ROWS, MOST_BATCHES, HELD_OUT = 200, 8, -1
#: Penalty of squared weights, step size, least gain of the held-out score, and epochs without one that end the fit.
ALPHA, RATE, LEAST_GAIN, PATIENCE = 1e-4, 1e-3, 1e-4, 10


def first_weights(sizes: tuple[int, int, int], seed: int) -> list[np.ndarray]:
    """Matrix and offsets of both layers, uniform within sqrt(6 / (inputs + outputs))."""
    r, out = np.random.default_rng(seed), []
    for a, b in zip(sizes, sizes[1:], strict=False):
        bound = np.sqrt(6 / (a + b))
        out += [r.uniform(-bound, bound, (a, b)), r.uniform(-bound, bound, b)]
    return out


def scores(weights: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hidden values, class scores) of rows."""
    hidden = np.maximum(x @ weights[0] + weights[1], 0)
    return hidden, hidden @ weights[2] + weights[3]


def gradients(weights: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Negative log shares of the rows' classes and their gradients, summed over the rows, without the penalty."""
    hidden, raw = scores(weights, x)
    raw = raw - raw.max(1, keepdims=True)
    logs = raw - np.log(np.exp(raw).sum(1, keepdims=True))
    own = np.arange(len(y)), y
    over = np.exp(logs)
    over[own] -= 1
    back = (over @ weights[2].T) * (hidden > 0)
    return float(-logs[own].sum()), [x.T @ back, back.sum(0), hidden.T @ over, over.sum(0)]


def flat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in parts])


def shaped(values: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    ends = np.cumsum([p.size for p in like])
    return [v.reshape(p.shape) for v, p in zip(np.split(values, ends[:-1]), like, strict=True)]


@dataclass
class Sums:
    """Of one job: rows, loss and gradients of the batch, rows and hits among those held out."""

    rows: float
    loss: float
    held: float
    hits: float
    gradients: np.ndarray


def summed(rows: DataFrame, weights: list[np.ndarray], batches: list[int]) -> Sums:
    """One job over (batch, label_idx, features) of the given batches; an array of the weights' size reaches the driver."""
    width = weights[0].shape[0]

    def partial(parts):
        total = np.zeros(4 + sum(w.size for w in weights))
        for b in slices(parts, 1024):
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
            y, held = b.column(1).to_numpy(zero_copy_only=False), b.column(0).to_numpy(zero_copy_only=False) == HELD_OUT
            total[2] += held.sum()
            total[3] += (scores(weights, x[held])[1].argmax(1) == y[held]).sum() if held.any() else 0
            if not held.all():
                loss, own = gradients(weights, x[~held], y[~held])
                total[0] += (~held).sum()
                total[1] += loss
                total[4:] += flat(own)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    own = rows.where(F.col("batch").isin(batches)).select("batch", "label_idx", "features").mapInArrow(partial, "s array<double>")
    found = own.select(F.posexplode("s").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros(4 + sum(w.size for w in weights))
    total[found["at"].to_numpy(int)] = found["v"].to_numpy(float)
    return Sums(*total[:4], total[4:])


@dataclass
class Network:
    """Weights, the held-out score after each epoch, and the mean loss of each epoch's batches while they were fitted."""

    weights: list[np.ndarray]
    held_out: list[float] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows with ``prediction``, the index of a class."""
        at, weights = rows.columns.index("features"), self.weights

        def run(parts):
            for b in slices(parts, 1024):
                x = b.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, weights[0].shape[0])
                best = scores(weights, x)[1].argmax(1).astype(float)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best)], names=[*b.schema.names, "prediction"])

        return rows.mapInArrow(run, rows.withColumn("prediction", F.lit(0.0)).schema)


def fit_network(train: DataFrame, n_classes: int, hidden: int = 128, epochs: int = 200, seed: int = 0) -> Network:
    """Fitted on (id, label_idx, features)."""
    spark, known = train.sparkSession, train.where(F.col("label_idx").between(0, n_classes - 1))
    size = known.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).first()
    if not size["n"]:
        raise ValueError("no rows to fit on")
    steps = int(min(MOST_BATCHES, max(1, -(-size["n"] // BATCH_ROWS))))
    drawn = lambda salt, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(n))
    batch = F.when(drawn("held out", 10) == 0, HELD_OUT).otherwise(drawn("batch", steps)).cast("int")
    held_in = staged_path(spark, "network-rows")
    placed = known.select(batch.alias("batch"), F.col("label_idx").cast("int").alias("label_idx"), F.col("features").cast("array<double>").alias("features"))
    placed.write.partitionBy("batch").parquet(held_in)  # a step reads its own files
    model = _descended(spark.read.schema(placed.schema).parquet(held_in), first_weights((size["d"], hidden, n_classes), seed), steps, epochs)
    remove(spark, held_in)
    return model


def _descended(rows: DataFrame, weights: list[np.ndarray], steps: int, epochs: int) -> Network:
    now, model = flat(weights), Network(weights)
    penalised = flat([np.full(w.shape, float(w.ndim == 2)) for w in weights])  # matrices, not offsets
    mean, square, moves, top, still, best = np.zeros_like(now), np.zeros_like(now), 0, -1.0, 0, None
    for epoch in range(epochs + 1):
        losses = []
        for step in range(steps if epoch < epochs else 1):
            scored = step == 0 and epoch > 0
            s = summed(rows, shaped(now, weights), ([step] if epoch < epochs else []) + ([HELD_OUT] if scored else []))
            if scored and s.held:
                score = float(s.hits / s.held)
                model.held_out.append(score)
                still = still + 1 if score < top + LEAST_GAIN else 0
                if score > top:
                    top, best = score, now
                if still > PATIENCE:
                    break
            if not s.rows:
                continue
            g = (s.gradients + ALPHA * penalised * now) / s.rows
            losses.append(s.loss / s.rows)
            moves += 1
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
            now = now - RATE * np.sqrt(1 - 0.999**moves) / (1 - 0.9**moves) * mean / (np.sqrt(square) + 1e-8)
        if still > PATIENCE:
            break
        if losses:
            model.losses.append(float(np.mean(losses)))
    model.weights = shaped(now if best is None else best, weights)
    return model
