"""Scalar expressions: times in file names, offsets, safe casts, decibels, mel, temporal overlap, array statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def audio_start(filename: Column) -> Column:
    """UTC start in a name like 2020-01-31T05-00-00_000.wav; null if it has another form."""
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract(filename, "[^/]*$", 0), "[.][^.]*$", ""), "_000$", "")
    return F.try_to_timestamp(stem, F.lit("yyyy-MM-dd'T'HH-mm-ss"))


def annotation_time(value: Column) -> Column:
    """ISO time, zone optional, as UTC (the session's zone must be UTC); null if it can't be read."""
    return F.try_to_timestamp(value)


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 1e6


def safe_double(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(default))


def finite_or(x: Column, default) -> Column:
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, default).otherwise(x)


def scrubbed(v: Column) -> Column:
    """Vector with null and non-finite components as 0."""
    return F.transform(v, lambda x: finite_or(x.cast("double"), F.lit(0.0)))


def decibels(power: Column) -> Column:
    return 10 * F.log10(F.greatest(power, F.lit(1e-10)))


def decibels_re_20_upa(power: Column) -> Column:
    """dB against (20 micropascal) squared; 0 where there is no power."""
    return F.when(power > 0, 10 * F.log10(power / (20e-6 * 20e-6))).otherwise(F.lit(0.0))


def hz_to_mel(f: Column) -> Column:
    return 2595 * F.log10(1 + f / 700)


def mel_to_hz(m: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), m / 2595) - 1)


def temporal_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over hull of two intervals; 0 for an empty hull."""
    both = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, both / hull).otherwise(F.lit(0.0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def mean(v: Column) -> Column:
    return F.when(F.size(v) > 0, total(v) / F.size(v)).otherwise(F.lit(0.0))


def std(v: Column) -> Column:
    """Population deviation, 0 when empty."""
    m = mean(v)
    return F.sqrt(mean(F.transform(v, lambda x: (x - m) * (x - m))))


def argmax(v: Column) -> Column:
    """First position of the maximum, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def entropy_share(v: Column) -> Column:
    """Entropy of a non-negative vector in bits, over log2 of its size."""
    t = total(v)
    bits = total(F.transform(v, lambda x: F.when(x > 0, -(x / t) * F.log2(x / t)).otherwise(F.lit(0.0))))
    return F.when((t > 0) & (F.size(v) > 1), bits / F.log2(F.size(v).cast("double"))).otherwise(F.lit(0.0))


def top_share(v: Column, share: float = 0.1) -> Column:
    """Part of the sum that the largest ``share`` of the entries hold."""
    k = F.greatest(F.lit(1), F.ceil(F.size(v) * share)).cast("int")
    t = total(v)
    return F.when(t > 0, total(F.slice(F.sort_array(v, asc=False), 1, k)) / t).otherwise(F.lit(0.0))


def focal_loss(p_true: Column, gamma: float = 2.0, weight: Column | float = 1.0) -> Column:
    p = F.greatest(p_true, F.lit(1e-12))
    return F.pow(1 - p, F.lit(gamma)) * -F.log(p) * weight
