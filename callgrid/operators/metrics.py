"""Classification metrics, all from one counted cube (groups..., true, pred, n).

The cube is the only aggregation over the predictions; every metric is a projection of it, for any group columns, so no
loop over groups or classes is needed and nothing larger than groups x classes squared is ever joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callgrid.operators import order_stats
from callgrid.operators.profile import class_table


def cube(predictions: DataFrame, groups=(), true: str = "y_true_label", pred: str = "y_pred_label") -> DataFrame:
    return predictions.groupBy(*groups, F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def _groups(c: DataFrame, groups) -> DataFrame | None:
    return c.select(*groups).distinct() if groups else None


def confusion(predictions: DataFrame, classes, groups=(), **names) -> DataFrame:
    """Dense (groups..., true, pred, n) over the declared classes. The class tables are of fixed size."""
    c = cube(predictions, groups, **names)
    dim = class_table(predictions.sparkSession, classes)
    grid = dim.select(F.col("label").alias("true"), F.explode(F.array(*[F.lit(x) for x in classes])).alias("pred"))
    if groups:
        grid = _groups(c, groups).select(*groups, F.explode(F.array(*[F.lit(x) for x in classes])).alias("true")).withColumn("pred",
            F.explode(F.array(*[F.lit(x) for x in classes])))
    on = [*groups, "true", "pred"]
    return grid.join(c, on, "left").select(*on, F.coalesce("n", F.lit(0)).alias("n"))


def normalised_confusion(dense: DataFrame, groups=()) -> DataFrame:
    """Share of each true class; rows without any stay 0."""
    return dense.withColumn("share", F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy(*groups, "true"))), F.lit(0.0)))


def confusion_table(dense: DataFrame, classes) -> DataFrame:
    """The dense matrix with a row per true label and a column per predicted one."""
    return dense.groupBy(F.col("true").alias("true_label")).pivot("pred", list(classes)).agg(F.sum("n")).orderBy("true_label")


def with_class_columns(predictions: DataFrame, classes, probs: str = "probs") -> DataFrame:
    """Predictions with a column prob_<class> for every declared class instead of the map, 0 where it has none."""
    return predictions.select(*[c for c in predictions.columns if c != probs], *[F.coalesce(F.try_element_at(probs, F.lit(c)),
        F.lit(0.0)).alias(f"prob_{c}") for c in classes])


def _ratio(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def per_class(dense: DataFrame, groups=()) -> DataFrame:
    """(groups..., label, precision, recall, f1, support, predicted); 0 where undefined."""
    sides = dense.select(*groups, F.explode(F.array(F.struct(F.col("true").alias("label"), F.lit(1).alias("t")), F.struct(F.col("pred").alias("label"),
        F.lit(0).alias("t")))).alias("x"), "n", (F.col("true") == F.col("pred")).alias("hit"))
    sums = sides.groupBy(*groups, F.col("x.label").alias("label")).agg(
        F.sum(F.col("n") * F.col("x.t")).alias("support"), F.sum(F.col("n") * (1 - F.col("x.t"))).alias("predicted"), F.sum(F.when(F.col("hit"),
            F.col("n") * F.col("x.t")).otherwise(0)).alias("tp"),
    )
    out = sums.withColumns({"precision": _ratio(F.col("tp"), F.col("predicted")), "recall": _ratio(F.col("tp"), F.col("support"))})
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.when(F.col("precision") + F.col("recall") > 0, F.col("precision") + F.col("recall")))
    return out.withColumn("f1", f1).select(*groups, "label", "precision", "recall", "f1", "support", "predicted", "tp")


def summary(classes_table: DataFrame, groups=()) -> DataFrame:
    """Accuracy; macro averages over all declared classes and over those present; balanced accuracy; weighted averages."""
    here = F.col("support") > 0
    weighted = {f"weighted_{m}": _ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")) for m in ("precision", "recall", "f1")}
    return classes_table.groupBy(*groups).agg(
        F.sum("support").alias("support"), _ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        F.coalesce(F.avg(F.when(here, F.col("f1"))), F.lit(0.0)).alias("present_macro_f1"), F.coalesce(F.avg(F.when(here, F.col("recall"))),
            F.lit(0.0)).alias("balanced_accuracy"),
        F.coalesce(F.avg(F.when(here | (F.col("predicted") > 0), F.col("f1"))), F.lit(0.0)).alias("macro_f1_fold"),
            F.min("recall").alias("min_class_recall"), *[v.alias(k) for k, v in weighted.items()],
    )


def metrics(predictions: DataFrame, classes, groups=(), **names) -> DataFrame:
    return summary(per_class(confusion(predictions, classes, groups, **names), groups), groups)


def report_rows(classes_table: DataFrame) -> DataFrame:
    """The per-class report unpivoted to (label, metric, score)."""
    return classes_table.select("label", F.explode(F.create_map(*[x for m in ("precision", "recall", "f1", "support") for x in (F.lit(m),
        F.col(m).cast("double"))])).alias("metric", "score"))


def errors(predictions: DataFrame) -> DataFrame:
    return predictions.where(F.col("y_true_label") != F.col("y_pred_label"))


def top_confusions(predictions: DataFrame) -> DataFrame:
    e = errors(predictions).groupBy("y_true_label", "y_pred_label").agg(F.count("*").alias("count"))
    return e.orderBy(F.desc("count"), "y_true_label", "y_pred_label")


def pair_confusions(predictions: DataFrame, a: str, b: str, both_ways: bool = True, columns=None) -> DataFrame:
    """Rows of a confused with b (and b with a), most confident first; one-way reports sort by dataset first."""
    t, p = F.col("y_true_label"), F.col("y_pred_label")
    rows = predictions.where((t == a) & (p == b) | ((t == b) & (p == a) if both_ways else F.lit(False)))
    order = [F.desc("pred_confidence")] if both_ways else ["dataset", F.desc("pred_confidence")]
    return rows.select(*[c for c in columns or rows.columns if c in rows.columns]).orderBy(*order)


def within_family_errors(predictions: DataFrame, families: dict) -> DataFrame:
    """(family, true, pred, count) of errors that stay inside a family of labels."""
    from callgrid.functions.labels import mapped

    e = errors(predictions).withColumns({"family": mapped(F.col("y_true_label"), families), "__other": mapped(F.col("y_pred_label"), families)})
    return e.where(F.col("family") == F.col("__other")).groupBy("family", "y_true_label",
        "y_pred_label").agg(F.count("*").alias("count")).orderBy("family", F.desc("count"), "y_true_label", "y_pred_label")


def predicted_vs_true(predictions: DataFrame, classes) -> DataFrame:
    """Counts of each class as truth and as prediction, and their difference."""
    c = cube(predictions)
    sums = c.select(F.explode(F.array(F.struct(F.col("true").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))).alias("x"))
    sums = sums.groupBy(F.col("x.label").alias("label")).agg(F.sum("x.t").alias("t"), F.sum("x.p").alias("p"))
    out = class_table(predictions.sparkSession, classes).join(sums, "label", "left")
    t, p = (F.coalesce(x, F.lit(0)).cast("long") for x in ("t", "p"))
    return out.select("label", t.alias("true_count"), p.alias("pred_count"), (p - t).alias("delta"))


def confidence_analysis(predictions: DataFrame, classes) -> DataFrame:
    """By true class: support, accuracy, mean and median probability of the truth, mean confidence; 0 when empty."""
    hit = (F.col("y_true_label") == F.col("y_pred_label")).cast("double")
    by = predictions.groupBy(F.col("y_true_label").alias("label")).agg(F.count("*").alias("support"), F.avg(hit).alias("accuracy"),
        F.avg("true_probability").alias("mean_true_probability"), F.avg("pred_confidence").alias("mean_confidence"))
    named = predictions.where("y_true_label IS NOT NULL").select(F.col("y_true_label").alias("label"), "true_probability")
    middle = order_stats.quantiles(named, ["label"], [0.5], "true_probability").select("label", F.col("q")[0].alias("median_true_probability"))
    out = class_table(predictions.sparkSession, classes).join(by.join(middle, "label"), "label", "left")
    return out.na.fill(0).select("label", "support", "accuracy", "mean_true_probability", "median_true_probability", "mean_confidence")


def majority_baseline(predictions: DataFrame, classes) -> DataFrame:
    """Predictions replaced by the most frequent true class; ties go to the class declared first."""
    best = confusion(predictions, classes).groupBy("true").agg(F.sum("n").alias("n"))
    rank = class_table(predictions.sparkSession, classes)
    label = best.join(rank, best["true"] == rank["label"]).agg(F.max_by("true", F.struct("n", -F.col("label_idx"))).alias("y_pred_label"))
    return predictions.drop("y_pred_label").join(F.broadcast(label))  # a single row


def permutation_baseline(predictions: DataFrame, id_column: str, seed: int = 0) -> DataFrame:
    """Predictions replaced by a permutation of the truth: the same multiset, re-paired by id order and by a seeded hash.

    Ranks come from range-partitioned sorts, not from one global window.
    """
    from callgrid.operators.folds import shuffled
    from callgrid.operators.sampling import global_rank

    a = global_rank(predictions.drop("y_pred_label"), [F.col(id_column)], "__at")
    truth = predictions.select(F.col("y_true_label").alias("y_pred_label"), F.col(id_column).alias("__id"))
    b = global_rank(truth, shuffled("__id", seed), "__at").select("__at", "y_pred_label")
    return a.join(b, "__at").drop("__at")


def pr_curve(predictions: DataFrame, score: str = "score", positive: str = "positive", groups=("label",)) -> DataFrame:
    """One-vs-rest precision and recall at each distinct score, highest first, and each point's share of the average precision."""
    by = predictions.groupBy(*groups, score).agg(F.sum(F.col(positive).cast("long")).alias("tp_here"), F.count("*").alias("n_here"))
    w = W.partitionBy(*groups).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("tp_here").over(W.partitionBy(*groups))
    pts = by.withColumns({"tp": F.sum("tp_here").over(w), "n": F.sum("n_here").over(w), "total": total})
    precision = F.col("tp") / F.col("n")
    return pts.select(*groups, score, precision.alias("precision"), _ratio(F.col("tp"), F.col("total")).alias("recall"),
        (precision * _ratio(F.col("tp_here"), F.col("total"))).alias("ap_part"))


def average_precision(predictions: DataFrame, score: str = "score", positive: str = "positive", groups=("label",)) -> DataFrame:
    return pr_curve(predictions, score, positive, groups).groupBy(*groups).agg(F.sum("ap_part").alias("average_precision"))


def threshold_report(classes_table: DataFrame, least: float = 0.8) -> DataFrame:
    return classes_table.where((F.col("recall") < least) | (F.col("f1") < least)).orderBy("f1", "label")


def with_true_probability(predictions: DataFrame, probs: str = "probs") -> DataFrame:
    """Adds pred_confidence and true_probability from a map label -> probability."""
    return predictions.withColumns({"pred_confidence": F.array_max(F.map_values(probs)), "true_probability": F.coalesce(F.try_element_at(probs,
        "y_true_label"), F.lit(0.0))})


def audit_checks(dense: DataFrame) -> DataFrame:
    """One row: total support, and whether every non-empty row of the normalised matrix sums to 1."""
    rows = normalised_confusion(dense).groupBy("true").agg(F.sum("share").alias("s"), F.sum("n").alias("n"))
    return rows.agg(F.sum("n").alias("support"), F.bool_and((F.col("n") == 0) | (F.abs(F.col("s") - 1) < 1e-9)).alias("rows_sum_to_one"))
