"""Split integrity: semi-joins of key sets between two splits, typed and null-safe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY_SETS = {
    "event": ("dataset", "filename", "label", "start_seconds", "end_seconds"),
    "audio_path": ("audio_path",),
    "file": ("dataset", "filename"),
    "source_row": ("dataset", "filename", "source_row"),
}
OPTIONAL = ("recording_id", "session_id", "audio_id")


def leaked(train: DataFrame, test: DataFrame, keys) -> DataFrame:
    """Train rows whose keys occur in the test rows; null equals null. The test side is reduced to distinct keys first."""
    other = test.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return train.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_semi")


def leakage_counts(rows: DataFrame, key_sets: dict = KEY_SETS, train: str = "train", test: str = "validation") -> DataFrame:
    """(check, leaked_rows): how many train rows share each key set with a test row."""
    a, b = rows.where(F.col("split") == train), rows.where(F.col("split") == test)
    sets = {k: v for k, v in key_sets.items() if set(v) <= set(rows.columns)} | {c: (c,) for c in OPTIONAL if c in rows.columns}
    parts = [leaked(a, b, v).agg(F.count("*").alias("leaked_rows")).select(F.lit(k).alias("check"), "leaked_rows") for k, v in sets.items()]
    return reduce(DataFrame.unionAll, parts)


def leakage_examples(rows: DataFrame, keys, limit: int = 5, train: str = "train", test: str = "validation") -> DataFrame:
    """The first few leaked keys, as a report shows them."""
    return leaked(rows.where(F.col("split") == train), rows.where(F.col("split") == test), keys).select(*keys).orderBy(*keys).limit(limit)


def require_no_leakage(rows: DataFrame, **how) -> None:
    found = {r["check"]: r["leaked_rows"] for r in leakage_counts(rows, **how).collect()}
    if any(found.values()):
        raise ValueError("leakage between splits: " + ", ".join(f"{k} {v}" for k, v in found.items() if v))


def key_overlap(rows: DataFrame, column: str, train: str = "train", test: str = "validation") -> DataFrame:
    """Values of a column that occur in both splits, sorted."""
    return rows.where(F.col("split") == train).select(column).intersect(rows.where(F.col("split") == test).select(column)).orderBy(column)
