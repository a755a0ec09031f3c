"""Connected components of a link table, as joins: each node takes the smallest of the labels around it and its label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrid.runtime import stage


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); label is the smallest node reachable.

    Links are light rows; labels are staged after each round, so no lineage builds up. Rounds grow with the logarithm of
    a component's diameter, as labels jump. Nothing is gathered: a round is three joins and one aggregation.
    """
    both = stage(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        lower = labels.join(near, "node").join(far, "label", "left")
        lower = stage(lower.select("node", F.col("label").alias("old"), F.least("label", "near", F.coalesce("far", "label")).alias("label")), "labels")
        labels = lower.select("node", "label")
        if lower.where("old <> label").isEmpty():
            return labels


def merged_components(labels: DataFrame, found: DataFrame) -> DataFrame:
    """``labels`` with further links (a, b) taken in: only the components that a link joins are worked on, as single nodes."""
    ends = found.select(F.col("a").alias("node")).unionAll(found.select(F.col("b").alias("node"))).distinct()
    fresh = ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    every = stage(labels.select("node", "label").unionAll(fresh), "labels-all")
    la, lb = (every.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    crossing = found.select("a", "b").join(la, "a").join(lb, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    joined = connected_components(crossing).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return stage(every.join(joined, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels-merged")
