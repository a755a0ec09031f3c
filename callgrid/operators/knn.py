"""Exact K nearest neighbours, in blocks.

Queries and train rows are cut into blocks by hash; every pair of blocks is one task with two matrices, which returns the
k best of its train block for each query, and a window keeps the k best of those. So no table of pairs is made, memory is
two blocks, and neither side is broadcast. Distances are rounded before ranking, ties go to the smaller train id.

Within a task every pair gets a lower bound of its distance, from matrix products in single precision or from sums of
small whole numbers; only pairs whose bound is no greater than the k-th distance found so far are measured in full. Work
still grows with queries times train rows. Blocks grow with the tables up to ``BLOCK`` rows, so copies of rows do not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callgrid.operators import order_stats
from callgrid.runtime import by_value, stage

by_value(__name__)

METRICS = ("euclidean", "manhattan", "cosine", "chebyshev", "minkowski")
#: Rows of a block at most, and at least, where a table has more; decimals of a distance.
BLOCK, LEAST, DIGITS = 81920, 1024, 9
#: Pairs of blocks that a search is cut into, or so many for each core where that is more; larger tables have more pairs only
#: beyond ``BLOCK`` rows.
PAIRS, PAIRS_A_CORE = 48, 4


def distances(q: np.ndarray, t: np.ndarray, metric: str, p: float = 2.0) -> np.ndarray:
    """Matrix of distances. Row by row for the metrics that have no matrix product, so memory stays one row of blocks."""
    if metric == "cosine":
        norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(t, axis=1)[None]
        return 1 - np.divide(q @ t.T, norm, out=np.zeros((len(q), len(t))), where=norm > 0)
    out = np.empty((len(q), len(t)))
    for i, row in enumerate(q):
        d = np.abs(t - row)
        if metric == "euclidean" or metric == "minkowski" and p == 2:
            out[i] = np.sqrt((d * d).sum(1))
        elif metric == "manhattan":
            out[i] = d.sum(1)
        elif metric == "chebyshev":
            out[i] = d.max(1) if d.shape[1] else 0
        elif metric == "minkowski":
            out[i] = (d**p).sum(1) ** (1 / p)
        else:
            raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    return out


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def paired(q: np.ndarray, t: np.ndarray, metric: str, p: float = 2.0) -> np.ndarray:
    """Distances of equal rows of two matrices, by the same sums as ``distances``."""
    if metric == "cosine":
        norm = np.linalg.norm(q, axis=1) * np.linalg.norm(t, axis=1)
        return 1 - np.divide((q * t).sum(1), norm, out=np.zeros(len(q)), where=norm > 0)
    d = np.abs(t - q)
    if metric == "euclidean" or metric == "minkowski" and p == 2:
        return np.sqrt((d * d).sum(1))
    if metric == "manhattan":
        return d.sum(1)
    if metric == "chebyshev":
        return d.max(1) if d.shape[1] else np.zeros(len(d))
    return (d**p).sum(1) ** (1 / p)


def lower_bounds(q: np.ndarray, t: np.ndarray, metric: str, p: float = 2.0):
    """(numbers, limits): a function of two ranges that gives a tile of numbers, and one of distances and a range of rows
    that gives a number for each row. A pair with a distance of at most d has a number of at most limits(d) in its row,
    whatever was rounded on the way, and within a row numbers order pairs much as distances do.

    Euclidean and cosine distances are bounded by products in single precision; Minkowski distances by Euclidean ones, with
    which they differ by a power of the dimensions at most; sums and maxima of differences by those of whole numbers on a
    grid. Values beyond the grid are moved to its ends, which only brings them nearer to each other."""
    n = q.shape[1]
    middle = np.zeros(n) if metric == "cosine" else t.mean(0)
    if metric in ("manhattan", "chebyshev"):
        spread = np.abs(t[:: max(1, len(t) // 4096)] - middle)
        half = float(np.quantile(spread, 0.9995) * 1.1) if spread.size else 0.0
        half = half or float(spread.max(initial=0)) or 1.0
        summed = metric == "manhattan"
        kind = np.int8 if not summed else np.uint16 if n <= 256 else np.uint32
        levels = 126 if not summed else (65535 if n <= 256 else 1 << 31) // max(1, n)
        step, most = 2 * half / levels, int(np.iinfo(kind).max)
        grid = lambda x: np.minimum(np.rint((np.clip(x - middle, -half, half) + half) / step), levels)
        x, y = grid(q) - (0 if summed else 63), grid(t).T - (0 if summed else 63)
        own, first = x.sum(1), np.mod(np.floor(-y.sum(0) / 2), most + 1).astype(kind) if summed else np.zeros(len(t), kind)
        x, y = x.astype(kind), np.ascontiguousarray(y.astype(kind))

        def on_grid(rows, columns):
            """Greatest differences; or halves of sums of differences and the row's own sum, by |x - y| = 2 max(x, y) - x - y
            in whole numbers that wrap around. Some rows at a time, which stay in the processor's cache."""
            out = np.empty((rows.stop - rows.start, len(first[columns])), kind)
            held = np.empty((32, out.shape[1]), kind)
            for lo in range(0, len(out), 32):
                part = out[lo : lo + 32]
                a, b, z = x[rows][lo : lo + 32], y[:, columns], held[: len(part)]
                part[:] = first[columns]
                for i in range(n):
                    if summed:
                        np.maximum(a[:, i, None], b[i], out=z)
                        np.add(part, z, out=part)
                    else:
                        np.subtract(a[:, i, None], b[i], out=z)
                        np.abs(z, out=z)
                        np.maximum(part, z, out=part)
            return out

        def grid_limits(d, rows):
            top = d / step * (1 + 1e-9) + (n if summed else 1) * (1 + 1e-6)  # half a step for each number of a difference
            return np.minimum(np.floor((own[rows] + top) / 2 + 1 if summed else top), most).astype(kind)

        return on_grid, grid_limits
    x, y = q - middle, t - middle
    if metric == "cosine":
        x, y = (np.divide(v, r, out=np.zeros_like(v), where=r > 0) for v, r in ((v, np.linalg.norm(v, axis=1)[:, None]) for v in (x, y)))
    size = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) or 1.0
    x, y = x / size, y / size
    a, b = (x * x).sum(1), (y * y).sum(1)
    slack = 2.0**-22 * (n + 16) * (float(a.max(initial=0)) + float(b.max(initial=0)))
    if metric == "cosine":
        left, right = -x, y
    else:  # |y|^2 - 2 xy in one product
        left, right = np.column_stack([-2 * x, np.ones(len(x))]), np.column_stack([y, b])
    left, right = left.astype(np.float32), np.ascontiguousarray(right.astype(np.float32).T)
    ratio = n ** max(0.0, 0.5 - 1 / p) if metric == "minkowski" and n else 1.0

    def product_limits(d, rows):
        top = (d - 1) / size**2 + slack if metric == "cosine" else (d * ratio * (1 + 1e-9) / size) ** 2 + slack - a[rows]
        return np.nextafter(top.astype(np.float32), np.float32(np.inf))

    return lambda rows, columns: left[rows] @ right[:, columns], product_limits


def nearest(q: np.ndarray, own: np.ndarray, t: np.ndarray, ids: np.ndarray, k: int, metric: str, p: float, exclude_self: bool,
    tile: tuple[int, int] = (256, 2048)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, train ids, distances) of the k nearest rows of ``t`` for each row of ``q``; non-finite distances are left out."""
    if metric == "cosine":  # a row that has no length lies at a right angle to all others
        q, t = (np.where(np.isnan(x).any(1, keepdims=True), 0.0, x) for x in (q, t))
    whole = [np.isfinite(x).all(1) for x in (q, t)]
    (q, own), (t, ids) = (q[whole[0]], own[whole[0]]), (t[whole[1]], ids[whole[1]])
    order = np.argsort(ids, kind="stable")
    t, ids = t[order], ids[order]
    found = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    if not len(q) or not len(t):
        return tuple(f[0] for f in found)
    numbers, limits = lower_bounds(q, t, metric, p)
    fast = metric == "minkowski" and p == int(p) and 2 < p <= 8
    q4, t4 = (q.astype(np.float32), t.astype(np.float32)) if fast else (q, t)

    def measured(i, j, cut):
        """(row, column, distance) of pairs; of those that whole powers in single precision rule out, none."""
        out = []
        for lo in range(0, len(i), 8192):
            x, y = i[lo : lo + 8192], j[lo : lo + 8192]
            if fast:
                with np.errstate(over="ignore", invalid="ignore"):
                    d = np.abs(t4[y] - q4[x])
                    size = np.abs(t4[y]).max(1) + np.abs(q4[x]).max(1)
                    held = d.copy()
                    for _ in range(int(p) - 1):
                        held *= d
                    # each difference is off by two units of its parts at most
                    far = held.sum(1) * (1 - 1e-4) > (cut[x] + d.shape[1] ** (1 / p) * size * 2.0**-22) ** p
                x, y = x[~far], y[~far]
            d = np.round(paired(q[x], t[y], metric, p), DIGITS)
            good = d < np.inf
            if exclude_self:
                good &= ids[y] != own[x]
            out.append((x[good], y[good], d[good]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def best_of(rows, columns, d):
        """The k best of each row; columns are in the order of ids."""
        at = np.lexsort((columns, d, rows))
        rows, columns, d = rows[at], columns[at], d[at]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        return rows[keep], columns[keep], d[keep]

    height, width = tile
    for lo in range(0, len(q), height):
        rows = slice(lo, min(lo + height, len(q)))
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        cut = np.full(len(q), np.inf) if lo == 0 else cut
        for start in range(0, len(t), width):
            r = numbers(rows, slice(start, start + width))
            if start == 0:  # the first limit: the k rows with the least bounds
                least = min(k + exclude_self, r.shape[1])
                j = np.argpartition(r, least - 1, axis=1)[:, :least].ravel() if least < r.shape[1] else np.tile(np.arange(least), len(r))
                x, _, d = best_of(*measured(np.repeat(np.arange(rows.start, rows.stop), least), j, cut))
                last = np.searchsorted(x, np.arange(rows.start, rows.stop), "right")
                count = last - np.searchsorted(x, np.arange(rows.start, rows.stop))
                cut[rows] = np.where(count >= k, np.append(d, np.inf)[last - 1], np.inf)
            at = np.flatnonzero(r <= limits(cut[rows] + 10.0**-DIGITS, rows)[:, None])
            if not len(at):
                continue
            i, j = at // r.shape[1] + rows.start, at % r.shape[1] + start
            new = measured(i, j, cut + 10.0**-DIGITS)
            best = best_of(*(np.concatenate(c) for c in zip(best, new, strict=True)))
            full = np.bincount(best[0] - rows.start, minlength=rows.stop - rows.start)
            last = np.cumsum(full) - 1
            has = full >= k
            cut[rows][has] = np.minimum(cut[rows][has], best[2][last[has]])
        for f, values in zip(found, (own[best[0]], ids[best[1]], best[2]), strict=True):
            f.append(values)
    return tuple(np.concatenate(f) for f in found)


def _blocks(train: int, queries: int, pairs: float, block: int = BLOCK) -> tuple[int, int]:
    """Numbers of train and query blocks that make about so many pairs, more where a block would exceed ``block`` rows."""
    n_t = min(max((pairs * train / max(1, queries)) ** 0.5, 1.0), pairs)
    shares = max(1, round(n_t)), max(1, round(pairs / n_t))
    return tuple(-(-n // min(block, max(LEAST, -(-n // share)))) or 1 for n, share in zip((train, queries), shares, strict=True))


def neighbours(train: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", p: float = 2.0, exclude_self: bool = False, block: int = BLOCK,
    by: str | None = None, staged: bool = False) -> DataFrame:
    """([by], query_id, rank from 1, neighbor_id, distance) from (id, features) tables; with ``by``, an integer column of
    both, queries meet the train rows of their own value only. Fewer train rows than k are all returned. ``staged``: both tables
    are read from files already."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    own_by = F.col(by).cast("int") if by else F.lit(0)
    train, queries = (x.select(own_by.alias("by"), "id", "features") for x in (train, queries))
    if not staged:  # each side is read twice
        train, queries = stage(train, "knn-train"), stage(queries, "knn-queries")
    sizes = [[r["count"] for r in x.groupBy("by").count().collect()] or [1] for x in (train, queries)]  # values of ``by``
    # Blocks grow with the tables, so that the copies of a row, one for each block of the other side, do not. With ``by``,
    # its values are tasks of their own already. Blocks of both sides are of like size: that makes the fewest copies.
    values = max(map(len, sizes))
    pairs = max(1.0, max(PAIRS, PAIRS_A_CORE * train.sparkSession.sparkContext.defaultParallelism) / values)
    n_t, n_q = _blocks(max(sizes[0]), max(sizes[1]), pairs, block)
    tasks = 4 * n_t * n_q * values  # by hash: with fewer, many would hold two pairs
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n - 1})"))
    key = ["by", "t", "q"]
    # A fixed number of partitions: by their bytes alone, small ones would be merged, whatever work they hold.
    t = train.select("by", part(n_t).alias("t"), every(n_q).alias("q"), "id", "features").repartition(tasks, *key)
    q = queries.select("by", every(n_t).alias("t"), part(n_q).alias("q"), "id", "features").repartition(tasks, *key)

    def meet(a, b):
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        of = 0
        if a.num_rows and b.num_rows:
            of = a.column("by")[0].as_py()
            found = nearest(_matrix(b.column("features")), b.column("id").to_numpy(), _matrix(a.column("features")), a.column("id").to_numpy(), k,
                metric, p, exclude_self)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64())
        columns = (np.full(len(found[0]), of), *found)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["by", "query_id", "neighbor_id", "distance"])

    pairs = t.groupBy(*key).cogroup(q.groupBy(*key)).applyInArrow(meet, "by int, query_id long, neighbor_id long, distance double")
    rank = F.row_number().over(W.partitionBy("by", "query_id").orderBy("distance", "neighbor_id"))
    out = pairs.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select(*([F.col("by").alias(by)] if by else []), "query_id", "rank", "neighbor_id", "distance")


def votes(near: DataFrame, labels: DataFrame, weights: str | Column = "uniform", by=()) -> DataFrame:
    """([by], query_id, label, vote, probability). With distance weights only neighbours at distance 0 vote, if there are
    any. ``weights`` may be a column of ``near`` that names the kind of each row."""
    if isinstance(weights, str) and weights not in ("uniform", "distance"):
        raise ValueError(f"unknown weights {weights!r}")
    key = [*by, "query_id"]
    named = near.join(labels.select(F.col("id").alias("neighbor_id"), "label"), "neighbor_id")
    zero = F.min("distance").over(W.partitionBy(*key)) == 0
    closeness = F.when(zero, (F.col("distance") == 0).cast("double")).otherwise(1 / F.col("distance"))
    if isinstance(weights, str):
        w = closeness if weights == "distance" else F.lit(1.0)
    else:
        w = F.when(weights == "distance", closeness).otherwise(F.lit(1.0))
    v = named.withColumn("w", w).groupBy(*key, "label").agg(F.sum("w").alias("vote"))
    return v.withColumn("probability", F.col("vote") / F.sum("vote").over(W.partitionBy(*key)))


def classify(voted: DataFrame, classes, by=()) -> DataFrame:
    """([by], query_id, y_pred_label, pred_confidence, probs): most votes, ties to the class declared first."""
    from callgrid.functions.labels import code

    best = F.max_by(F.struct("label", "probability"), F.struct(F.round("vote", 9), -code(F.col("label"), classes)))
    out = voted.groupBy(*by, "query_id").agg(best.alias("b"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "probability")))).alias("probs"))
    return out.select(*by, "query_id", F.col("b.label").alias("y_pred_label"), F.col("b.probability").alias("pred_confidence"), "probs")


def distance_text(distance: Column, decimals: int | None = None) -> Column:
    """A distance with eight significant digits, without trailing zeros; for values from 0.001 to ten million. With
    ``decimals``, no more digits than that follow the point, rounded by the exact value as printf does; values may be smaller."""
    scale = F.pow(F.lit(10.0), 7 - F.floor(F.log10(distance)))
    value = F.round(distance * scale) / scale
    if decimals is None:
        text = F.regexp_replace(value.cast("string"), "[.]0$", "")
    else:
        text = F.call_function("format_number", value, F.lit("0." + "#" * decimals))
    return F.when(distance == 0, F.lit("0")).otherwise(text)


def neighbour_report(near: DataFrame, meta: DataFrame) -> DataFrame:
    """One row a query: the neighbours' ids, labels and domains in order, and their mean distance."""
    rows = near.join(meta.select(F.col("id").alias("neighbor_id"), "label", "domain"), "neighbor_id")
    of = F.array_sort(F.collect_list(F.struct("rank", "neighbor_id", "label", "domain", "distance")))
    text = lambda c: F.array_join(F.transform("x", lambda r: r[c].cast("string")), " ")
    return rows.groupBy("query_id").agg(of.alias("x"), F.avg("distance").alias("mean_distance")).select("query_id",
        text("neighbor_id").alias("neighbor_ids"), text("label").alias("neighbor_labels"), text("domain").alias("neighbor_domains"), "mean_distance")


def distance_stats(report: DataFrame, correct: str = "correct") -> DataFrame:
    """Mean neighbour distances by correctness: count, mean, median, 90th percentile."""
    q = order_stats.quantiles(report, [correct], [0.5, 0.9], "mean_distance")
    plain = report.groupBy(correct).agg(F.count("*").alias("n"), F.avg("mean_distance").alias("mean"))
    return plain.join(q, correct).select(correct, "n", "mean", F.col("q")[0].alias("median"), F.col("q")[1].alias("p90"))
