"""Mutual information between columns and a label by nearest neighbours (Ross 2014), for columns that fit in no task.

A column is laid out in sorted ranges twice. Sorted within its labels, a value's nearest of its own label stand beside it;
a range knows the ``k`` values before its first and behind its last row from the ranges' border rows alone. Sorted as a
whole, with the two ends of each value's interval among the points, a running count and the counts of earlier ranges give
how many values lie between the ends. No window spans more than a range, however many rows a column or a label has.

Values are scaled and get a seeded tiny noise, which breaks ties; it is drawn once and staged. Null and non-finite values
are left out. A null label is a label of its own; labels of one row are left out. A column without values scores null, one
without a label of two rows 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callgrid.functions.scalars import finite_or
from callgrid.operators.order_stats import before, buckets
from callgrid.runtime import stage

EULER = 0.5772156649015329
#: Below this the sum is exact, above the series is.
HARMONIC = 50


def digamma(n: Column) -> Column:
    """Of a whole number above 0."""
    small = F.lit([-EULER + sum(1 / i for i in range(1, m)) for m in range(1, HARMONIC)])
    return F.when(n < HARMONIC, F.get(small, n.cast("int") - 1)).otherwise(F.log(n) - 1 / (2 * n) - 1 / (12 * n * n))


def _laid_out(values: DataFrame, keys: list[str], seed: int, tasks: int | None) -> DataFrame:
    """(keys, label, z, bucket, id) in ranges of (keys, label, z)."""
    rows = values.select(*keys, F.coalesce(F.col("label").cast("string"), F.lit("None")).alias("label"),
                         finite_or(F.col("x").cast("double"), F.lit(None)).alias("x")).where("x IS NOT NULL")
    spread = stage(rows.groupBy(*keys).agg(F.stddev_pop("x").alias("s"), F.avg(F.abs("x")).alias("m")), "information-scales")
    size = F.when(F.col("s") > 0, F.col("s")).otherwise(F.lit(1.0))
    noise = 1e-10 * F.greatest(F.lit(1.0), F.col("m") / size) * F.randn(seed)
    noisy = rows.join(spread, keys).select(*keys, "label", (F.col("x") / size + noise).alias("z"), F.monotonically_increasing_id().alias("id"))
    return buckets(noisy, [*keys, "label", "z"], "information-labels", tasks)


def _intervals(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, id, n_label, near, low, high): the open interval up to the ``near``-th neighbour of the value's label."""
    own = [*keys, "label", "bucket"]
    order = W.partitionBy(*own).orderBy("z", "id")
    placed = rows.withColumns({"nth": F.row_number().over(order), "size": F.count("*").over(W.partitionBy(*own))})
    borders = W.partitionBy(*keys, "label").orderBy("bucket", "nth")  # 2 k rows a range at most
    beside = placed.where((F.col("nth") <= k) | (F.col("nth") > F.col("size") - k)).withColumns({
        "earlier": F.collect_list("z").over(borders.rowsBetween(-k, -1)), "later": F.collect_list("z").over(borders.rowsBetween(1, k))})
    halo = beside.groupBy(*own).agg(F.max(F.when(F.col("nth") == 1, F.col("earlier"))).alias("halo_before"),
                                    F.max(F.when(F.col("nth") == F.col("size"), F.col("later"))).alias("halo_after"))
    sizes = rows.groupBy(*keys, "label").agg(F.count("*").alias("n_label")).where("n_label > 1")
    around = rows.withColumns({"left": F.collect_list("z").over(order.rowsBetween(-k, -1)), "right": F.collect_list("z").over(order.rowsBetween(1, k))})
    around = around.join(halo, own).join(sizes, [*keys, "label"])
    left = F.concat("halo_before", "left")
    near = F.concat(F.slice(left, F.greatest(F.lit(1), F.size(left) - k + 1), k), F.slice(F.concat("right", "halo_after"), 1, k))
    by_distance = F.array_sort(F.transform(near, lambda v: F.struct(F.abs(v - F.col("z")).alias("d"), v.alias("v"))))
    nth = F.least(F.lit(k), F.col("n_label") - 1).cast("int")
    end = around.select(*keys, "id", "z", "n_label", nth.alias("near"), F.element_at(by_distance, nth).alias("e"))
    # the neighbour itself is one end, so that no rounding moves it inside
    low = F.when(F.col("e.v") < F.col("z"), F.col("e.v")).otherwise(F.col("z") - F.col("e.d"))
    high = F.when(F.col("e.v") > F.col("z"), F.col("e.v")).otherwise(F.col("z") + F.col("e.d"))
    return end.select(*keys, "id", "n_label", "near", low.alias("low"), high.alias("high"))


def _counted(rows: DataFrame, intervals: DataFrame, keys: list[str], tasks: int | None) -> DataFrame:
    """(keys, id, n_label, near, m): values of the whole column inside each open interval."""
    point, upper, lower = 1, 0, 2  # at equal values: upper ends before points, lower ends behind them
    none = F.lit(None).cast("long")
    ends = intervals.select(*keys, "id", "n_label", "near", F.explode(F.array(
        F.struct(F.col("high").alias("v"), F.lit(upper).alias("kind")), F.struct(F.col("low").alias("v"), F.lit(lower).alias("kind")))).alias("e"))
    ends = ends.select(*keys, "e.v", "e.kind", "id", "n_label", "near")
    points = rows.select(*keys, F.col("z").alias("v"), F.lit(point).alias("kind"), none.alias("id"), none.alias("n_label"), none.cast("int").alias("near"))
    mixed = buckets(points.unionByName(ends), [*keys, "v", "kind"], "information-ranks", tasks)
    is_point = (F.col("kind") == point).cast("long")
    earlier = before(mixed.groupBy(*keys, "bucket").agg(F.sum(is_point).alias("n")), keys)
    running = F.sum(is_point).over(W.partitionBy(*keys, "bucket").orderBy("v", "kind").rowsBetween(W.unboundedPreceding, 0))
    ranked = mixed.withColumn("rank", running).where(F.col("kind") != point).join(earlier, [*keys, "bucket"])
    rank = F.col("rank") + F.col("before")
    inside = F.sum(F.when(F.col("kind") == upper, rank).otherwise(-rank))
    return ranked.groupBy(*keys, "id").agg(inside.alias("m"), F.max("n_label").alias("n_label"), F.max("near").alias("near"))


def mutual_information_scores(values: DataFrame, keys: list[str], seed: int = 0, k: int = 3, tasks: int | None = None) -> DataFrame:
    """(keys, score) from rows (keys, x, label). Keys are not null."""
    rows = _laid_out(values, keys, seed, tasks)
    counted = _counted(rows, _intervals(rows, keys, k), keys, tasks)
    term = digamma(F.col("near")) - digamma(F.col("n_label")) - digamma(F.greatest(F.lit(1), F.col("m")))
    sums = counted.groupBy(*keys).agg(F.sum(term).alias("total"), F.count("*").alias("used"))
    score = F.greatest(F.lit(0.0), digamma(F.col("used")) + F.col("total") / F.col("used"))
    every = values.groupBy(*keys).agg(F.count(finite_or(F.col("x").cast("double"), F.lit(None))).alias("n"))
    out = every.join(sums, keys, "left")
    return out.select(*keys, F.when(F.col("n") > 0, F.coalesce(score, F.lit(0.0))).alias("score"))
