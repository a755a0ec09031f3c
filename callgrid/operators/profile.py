"""Counts and distributions of a manifest. Each is one aggregation; dense tables join a small class dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def counts(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows by columns; null groups count."""
    return rows.groupBy(*columns).agg(F.count("*").alias("count")).orderBy(*columns)


def counts_of_existing(rows: DataFrame, *columns: str) -> DataFrame | None:
    """Counts by those columns that exist; nothing if none does."""
    have = [c for c in columns if c in rows.columns]
    return counts(rows, *have) if have else None


def distribution(rows: DataFrame, label: str = "label", within=()) -> DataFrame:
    """Count and fraction by label, inside the groups of ``within``."""
    n = F.sum("count").over(W.partitionBy(*within))
    return counts(rows, *within, label).withColumn("fraction", F.coalesce(F.try_divide(F.col("count"), n), F.lit(0.0)))


def class_table(spark, classes) -> DataFrame:
    """The class dimension (label, label_idx): one row per declared class."""
    items = ", ".join("'" + c.replace("'", "\\'") + "'" for c in classes)
    return spark.sql(f"SELECT label, CAST(label_idx AS int) AS label_idx FROM (SELECT posexplode(array({items})) AS (label_idx, label))")


def dense_distribution(rows: DataFrame, classes, label: str = "label") -> DataFrame:
    """Counts and fractions over all declared classes, 0 where there are none."""
    have = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("count"))
    out = class_table(rows.sparkSession, classes).join(have, "label", "left").select("label", "label_idx", F.coalesce("count", F.lit(0)).alias("count"))
    return out.withColumn("fraction", F.coalesce(F.try_divide(F.col("count"), F.sum("count").over(W.partitionBy())), F.lit(0.0))).orderBy("label_idx")


def split_distribution(rows: DataFrame) -> DataFrame:
    """Counts by split and label, and of each label over all splits (split 'all'), in one grouping-sets aggregation."""
    cube = rows.groupingSets([["split", "label"], ["label"]], "split", "label").agg(F.count("*").alias("count"), F.grouping("split").alias("__all"))
    return cube.select(F.when(F.col("__all") == 1, "all").otherwise(F.col("split")).alias("split"), "label", "count").orderBy("split", "label")


def imbalance_ratio(rows: DataFrame, label: str = "label", within=()) -> DataFrame:
    """Largest class over smallest non-empty class."""
    by = rows.groupBy(*within, label).agg(F.count("*").alias("n")).where("n > 0")
    return by.groupBy(*within).agg(F.max("n").alias("largest"), F.min("n").alias("smallest"), (F.max("n") / F.min("n")).alias("imbalance_ratio"))


def crosstab(rows: DataFrame, a: str, b: str, values) -> DataFrame:
    """Counts by a, a column for each listed value of b."""
    return rows.groupBy(a).pivot(b, list(values)).agg(F.count(F.lit(1))).na.fill(0).orderBy(a)


def quality_summary(issues: DataFrame) -> DataFrame:
    """Issues by kind (before a colon's detail), split, dataset and label; nulls are groups."""
    return counts(issues, "issue", "split", "dataset", "label")


def label_audit(rows: DataFrame, mapping: dict) -> DataFrame:
    """Counts by split, dataset, label and mapped label (itself where unmapped)."""
    from callgrid.functions.labels import aggregated

    return counts(rows.withColumn("mapped", aggregated(F.col("label"), mapping)), "split", "dataset", "label", "mapped")


def unknown_labels(rows: DataFrame, known, label: str = "label") -> DataFrame:
    return rows.where(F.col(label).isNotNull() & ~F.col(label).isin(*known)).select(label).distinct().orderBy(label)


def distinct_with_null(rows: DataFrame, *columns: str) -> DataFrame:
    """Number of distinct values of each column, null being one."""
    n = [(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns]
    return rows.agg(*n).select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("column", "n_distinct"))


def evaluability(rows: DataFrame, classes, least: int = 2, label: str = "label") -> DataFrame:
    """One row: whether every declared class has enough rows, and the smallest class."""
    d = dense_distribution(rows, classes, label)
    return d.agg((F.min("count") >= least).alias("evaluable"), F.min_by("label", F.struct("count", "label_idx")).alias("smallest_class"),
        F.min("count").alias("smallest_count"))


def class_weights(rows: DataFrame, classes, multipliers: dict | None = None, label: str = "label") -> DataFrame:
    """Weight total / max(1, count) by class, scaled to mean 1; then times the multipliers, scaled again."""
    from callgrid.functions.labels import mapped

    every = W.partitionBy()
    d = dense_distribution(rows, classes, label).withColumn("w", F.sum("count").over(every) / F.greatest(F.lit(1), "count"))
    d = d.withColumn("w", F.col("w") / F.avg("w").over(every))
    if multipliers:
        d = d.withColumn("w", F.col("w") * F.coalesce(mapped(F.col("label"), {k: float(v) for k, v in multipliers.items()}), F.lit(1.0)))
        d = d.withColumn("w", F.col("w") / F.avg("w").over(every))
    return d.select("label", "label_idx", "count", F.col("w").alias("weight"))


def sample_weights(rows: DataFrame, weights: DataFrame, label: str = "label") -> DataFrame:
    """Every row with its class's weight. The weights have one row per class."""
    return rows.join(weights.select(F.col("label").alias(label), "weight"), label, "left")
