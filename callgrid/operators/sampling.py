"""Samples and ranks: first N, hash-random N, coverage-first truncation, global ranks without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callgrid.runtime import stage


def first_n(rows: DataFrame, group, order, n: int) -> DataFrame:
    """The first n rows of each group; the plan limits groups before the shuffle (WindowGroupLimit)."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def random_n(rows: DataFrame, group, id_column: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group in a seeded hash order, the same on every run; all rows if n is not positive."""
    return rows if n <= 0 else first_n(rows, group, [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_column).cast("string"))), F.col(id_column)], n)


def coverage_first(rows: DataFrame, group: str, order, n: int) -> DataFrame:
    """n rows: one of each group first, then the others, both in the given order."""
    own = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return rows.withColumn("__later", own > 1).orderBy("__later", *order).limit(n).drop("__later")


def best_of_group(rows: DataFrame, group: str, order) -> DataFrame:
    """The best row of each group with the number of rows in it."""
    return first_n(rows.withColumn("n_candidates", F.count("*").over(W.partitionBy(group))), [group], order, 1)


def global_rank(rows: DataFrame, order, name: str) -> DataFrame:
    """Rank from 0 over the whole table. Rows are range-partitioned and ranked inside their partition; only the counts of
    the partitions meet in one place."""
    keys = {f"__k{i}": o for i, o in enumerate(order)}
    parts = rows.withColumns(keys).repartitionByRange(*keys).withColumn("__part", F.spark_partition_id())
    parts = stage(parts, "ranked")  # the partition of a row must not change between the two uses
    before = F.coalesce(F.sum("n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("__part").agg(F.count("*").alias("n")).select("__part", before.alias("__before"))
    own = F.row_number().over(W.partitionBy("__part").orderBy(*keys))
    return parts.withColumn("__own", own).join(starts, "__part").withColumn(name, F.col("__own") - 1 + F.col("__before")).drop("__part", "__own",
        "__before", *keys)
