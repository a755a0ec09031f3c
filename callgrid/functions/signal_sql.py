"""Signal features as array expressions: the whole computation stays in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from callgrid.functions.scalars import total


def power_spectrum(x: Column, n: int) -> Column:
    """One-sided power of the discrete Fourier transform of ``n`` samples, from its definition (small n)."""
    ks = F.sequence(F.lit(0), F.lit(n // 2))
    turn = lambda k, i: F.lit(-2 * math.pi / n) * k * i
    part = lambda k, f: total(F.transform(x, lambda v, i: v.cast("double") * f(turn(k, i))))
    return F.transform(ks, lambda k: F.pow(part(k, F.cos), F.lit(2)) + F.pow(part(k, F.sin), F.lit(2)))


def frequencies(n: int, rate: float) -> Column:
    return F.lit([k * rate / n for k in range(n // 2 + 1)])


def centroid(p: Column, f: Column) -> Column:
    t = total(p)
    return F.when(t > 0, total(F.zip_with(p, f, lambda a, b: a * b)) / t).otherwise(F.lit(0.0))


def bandwidth(p: Column, f: Column) -> Column:
    t, c = total(p), centroid(p, f)
    return F.when(t > 0, F.sqrt(total(F.zip_with(p, f, lambda a, b: a * (b - c) * (b - c))) / t)).otherwise(F.lit(0.0))


def cumulated(p: Column) -> Column:
    """Running sums, in one pass."""
    return F.aggregate(p, F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x)))


def rolloff(p: Column, f: Column, share: float = 0.85) -> Column:
    """First frequency at which the running power reaches a share of the total."""
    t = total(p)
    return F.get(f, F.size(F.filter(cumulated(p), lambda c: c < t * share)))


def band_energy(p: Column, f: Column, low: float, high: float) -> Column:
    """Power in [low, high)."""
    return total(F.zip_with(p, f, lambda a, b: F.when((b >= low) & (b < high), a).otherwise(F.lit(0.0))))


def framed(x: Column, size: int, hop: int) -> Column:
    """Frames of ``size`` every ``hop`` samples; a short signal is one zero-padded frame."""
    n = F.size(x)
    last = F.when(n >= size, F.floor((n - size) / hop)).otherwise(F.lit(0)).cast("int")
    padded = F.when(n >= size, x).otherwise(F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), size - n))))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(padded, i * hop + 1, F.lit(size)))


def rms(x: Column) -> Column:
    return F.sqrt(total(F.transform(x, lambda v: v * v)) / F.greatest(F.lit(1), F.size(x)))


def zero_crossing_rate(x: Column) -> Column:
    """Share of neighbouring samples whose signs differ; 0 counts as positive."""
    turns = total(F.transform(x, lambda v, i: F.when((i > 0) & ((v < 0) != (F.get(x, i - 1) < 0)), 1.0).otherwise(0.0)))
    return turns / F.greatest(F.lit(1), F.size(x) - 1)


def difference(x: Column) -> Column:
    """First difference; the first entry is 0."""
    return F.transform(x, lambda v, i: v - F.coalesce(F.when(i > 0, F.get(x, i - 1)), v))


def moving_average(x: Column) -> Column:
    """Three-tap mean with zeros beyond the ends."""
    at = lambda i: F.coalesce(F.when((i >= 0) & (i < F.size(x)), F.get(x, i)), F.lit(0.0))
    return F.transform(x, lambda v, i: (at(i - 1) + v + at(i + 1)) / 3)


def peak_count(x: Column) -> Column:
    """Local maxima at or above mean plus deviation; a plateau counts once, the ends don't."""
    from callgrid.functions.scalars import mean, std

    runs = F.filter(x, lambda v, i: (i == 0) | (v != F.get(x, i - 1)))
    inner = lambda r, level: F.filter(r, lambda v, i: (i > 0) & (i < F.size(r) - 1) & (v > F.get(r, i - 1)) & (v > F.get(r, i
        + 1)) & (v >= level))
    counted = F.transform(F.array(F.struct(runs.alias("r"), (mean(x) + std(x)).alias("level"))), lambda s: F.size(inner(s["r"], s["level"])))
    return F.element_at(counted, 1)


def chunks(x: Column, k: int) -> Column:
    """k consecutive parts; the first n mod k are one longer."""
    n = F.size(x)
    base, more = F.floor(n / k).cast("int"), (n % k).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.slice(x, j * base + F.least(j, more) + 1, base + F.when(j < more, 1).otherwise(0)))


def weighted_histogram(x: Column, w: Column, bins: int) -> Column:
    """Weights summed in equal bins over [0, 1]; 1 is in the last bin."""
    at = F.transform(x, lambda v: F.least(F.lit(bins - 1), F.floor(v * bins)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: total(F.zip_with(at, w, lambda i, m: F.when(i == b, m).otherwise(F.lit(0.0)))))
