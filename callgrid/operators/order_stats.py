"""Exact order statistics of columns that fit in no task: quantiles by narrowing rounds, ranks by sorted ranges.

``quantiles``: every wanted rank has a bracket of values. A round takes splitters of each bracket from a mergeable sketch,
moves the bracket to the splitters about its rank, and counts exactly what lies below and inside. Only counts and sketches
are shuffled. When brackets hold few values, those alone are sorted. The sketch chooses splitters, the counts decide, so
results are exact whatever the sketch's error.

``buckets``: rows laid out in ranges of a sort order, each with its number, so that windows over a range replace a window
over a whole group; ``before`` says how many rows of a group lie in earlier ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callgrid.runtime import stage

#: Values of a bracket that may be sorted in one task, and splitters of a round.
FEW, SPLITTERS = 100_000, 512


def _inside(values: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Values with their groups' brackets (keys, lo, hi); the brackets are few, so Spark may broadcast them by their size."""
    return values.join(brackets, keys)


def _narrowed(values: DataFrame, targets: DataFrame, keys: list[str], few: int, splitters: int) -> DataFrame:
    """Targets with smaller brackets, where their old ones hold more than ``few`` values."""
    wide = (F.col("within") > few) & (F.col("lo") < F.col("hi"))
    own = [*keys, "lo", "hi"]
    met = _inside(values, targets.where(wide).select(*own).distinct(), keys).where("x >= lo AND x <= hi")
    shares = F.array(*[F.lit(i / splitters) for i in range(splitters + 1)])
    found = met.groupBy(*own).agg(F.percentile_approx("x", shares, F.lit(20 * splitters)).alias("s"))
    at = lambda rank: (rank - F.col("below")) / F.col("within") * splitters
    low, high = (F.floor(at(F.col("first"))) - 2).cast("int"), (F.ceil(at(F.col("second") + 1)) + 2).cast("int")
    moved = targets.join(found, own, "left").withColumns({
        "new_lo": F.when(F.col("s").isNotNull() & (low >= 0), F.get("s", low)).otherwise(F.col("lo")),
        "new_hi": F.when(F.col("s").isNotNull() & (high <= splitters), F.get("s", high)).otherwise(F.col("hi")),
    }).drop("s")
    moved = stage(moved, "quantile-brackets")
    asked = moved.where("new_lo > lo OR new_hi < hi").select(*keys, "new_lo", "new_hi").distinct()
    counts = _inside(values, asked, keys).groupBy(*keys, "new_lo", "new_hi").agg(
        F.count_if(F.col("x") < F.col("new_lo")).alias("b"), F.count_if((F.col("x") >= F.col("new_lo")) & (F.col("x") <= F.col("new_hi"))).alias("w"))
    out = moved.join(counts, [*keys, "new_lo", "new_hi"], "left")
    holds = F.coalesce((F.col("b") <= F.col("first")) & (F.col("b") + F.col("w") > F.col("second")), F.lit(False))
    pick = lambda new, old: F.when(holds, F.col(new)).otherwise(F.col(old))
    return out.select(*keys, "t", "share", "first", "second", pick("new_lo", "lo").alias("lo"), pick("new_hi", "hi").alias("hi"),
                      pick("b", "below").alias("below"), pick("w", "within").alias("within"))


def quantiles(rows: DataFrame, keys: list[str], probabilities, column: str = "x", few: int = FEW, splitters: int = SPLITTERS) -> DataFrame:
    """(keys, q): q the exact quantiles of the group's values with linear interpolation, null for a group without values.

    Null values are left out; NaN counts as one. Keys are not null. The plan has a round for each factor of about a hundred
    by which the largest group exceeds ``few``; a group of any size, of one value or of many, is never in one task."""
    values = rows.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("x")).where(~F.isnan("x"))
    groups = rows.select(*keys, F.col(column).cast("double").alias("x")).groupBy(*keys).agg(F.count(F.when(~F.isnan("x"), F.col("x"))).alias("n"))
    groups = stage(groups, "quantile-groups")
    rank = (F.col("n") - 1) * F.col("p")
    targets = groups.where("n > 0").select(*keys, "n", F.posexplode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("t", "p"))
    targets = targets.select(*keys, "t", (rank - F.floor(rank)).alias("share"), F.floor(rank).alias("first"), F.ceil(rank).alias("second"),
                             F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0).cast("long").alias("below"), F.col("n").alias("within"))
    most = lambda t: t.where("lo < hi").agg(F.max("within"), F.sum("within")).first()  # noqa: E731  two numbers
    widest = groups.agg(F.max("n")).first()[0] or 0
    held = None
    while widest > few:
        targets = stage(_narrowed(values, targets, keys, few, splitters), "quantile-targets")
        now = most(targets)
        if now == held:  # no bracket can be narrowed: what is left inside is mostly one value each
            break
        held, widest = now, now[0] or 0
    own = [*keys, "lo", "hi"]
    met = _inside(values, targets.select(*own, "below").distinct(), keys).where("x >= lo AND x <= hi")
    each = met.groupBy(*own, "below", "x").agg(F.count("*").alias("c"))
    last = F.sum("c").over(W.partitionBy(*own).orderBy("x")) + F.col("below")
    ranked = each.withColumn("end", last).select(*own, "x", (F.col("end") - F.col("c")).alias("start"), "end")
    pairs = targets.join(ranked, own).where("end > first AND start <= second")
    at = lambda r: F.max(F.when((F.col("start") <= F.col(r)) & (F.col(r) < F.col("end")), F.col("x")))
    found = pairs.groupBy(*keys, "t", "share").agg(at("first").alias("a"), at("second").alias("b"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - F.col("share")) * F.col("a") + F.col("share") * F.col("b"))
    lists = found.select(*keys, F.struct("t", value.alias("v")).alias("s")).groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return groups.select(*keys).join(lists.select(*keys, F.col("s.v").alias("q")), keys, "left")


def buckets(rows: DataFrame, order: list[str | Column], label: str, tasks: int | None = None) -> DataFrame:
    """The rows, staged in ranges of ``order``, with their range's number ``bucket``. Rows that are equal in all of ``order``
    share a range."""
    tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(rows.repartitionByRange(tasks, *order).withColumn("bucket", F.spark_partition_id()), label)


def before(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """(keys, bucket, before): rows of the group in earlier buckets, from its rows by bucket."""
    earlier = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # a row for each bucket
    return counts.select(*keys, "bucket", F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias("before"))
