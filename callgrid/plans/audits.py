"""Audits over manifests and predictions: imbalance, leakage, notebook-style evaluation. Each returns plain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callgrid.operators import fitted, folds, knn, leakage, metrics, profile
from callgrid.plans import pipelines
from callgrid.runtime import stage

#: The classifier of the notebook evaluation.
NOTEBOOK = {"imputer": "mean", "scaler": "standard", "reducer": "none", "k": 5, "weights": "uniform", "metric": "euclidean", "p": 2}
EVENT = ("dataset", "filename", "label", "start_datetime", "end_datetime")


def class_distributions(manifest: DataFrame, classes) -> DataFrame:
    """(split, label, count, fraction, imbalance_ratio) over all declared classes, for each split and for all together."""
    counts = profile.split_distribution(manifest)
    grid = counts.select("split").distinct().select("split", F.posexplode(F.array(*[F.lit(c) for c in classes])).alias("label_idx", "label"))
    dense = grid.join(counts, ["split", "label"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    own = W.partitionBy("split")
    share = F.coalesce(F.try_divide(F.col("count"), F.sum("count").over(own)), F.lit(0.0))
    ratio = F.coalesce(F.try_divide(F.max("count").over(own), F.min(F.when(F.col("count") > 0, F.col("count"))).over(own)), F.lit(0.0))
    return dense.select("split", "label", "count", share.alias("fraction"), ratio.alias("imbalance_ratio"))


def overlaps(manifest: DataFrame, train: str = "train", test: str = "validation") -> DataFrame:
    """(check, overlap): distinct keys that both splits have, of events, audio files and datasets."""
    a, b = manifest.where(F.col("split") == train), manifest.where(F.col("split") == test)
    parts = [a.select(*k).intersect(b.select(*k)).agg(F.count("*").alias("overlap")).select(F.lit(n).alias("check"), "overlap") for n, k in (("event",
        EVENT), ("audio_path", ("audio_path",)), ("dataset", ("dataset",)))]
    return reduce(DataFrame.unionAll, parts)


def imbalance_audit(manifest: DataFrame, predictions: DataFrame, classes) -> dict[str, DataFrame]:
    """Distributions, overlaps, the classes that fall short, the simplest baselines, and checks of the artifacts."""
    dense = metrics.confusion(predictions, classes)
    per_class = metrics.per_class(dense)
    both = {"model": predictions, "majority": metrics.majority_baseline(predictions, classes), "permutation": metrics.permutation_baseline(predictions, "id")}
    scores = reduce(DataFrame.unionAll, [metrics.metrics(p, classes).select(F.lit(n).alias("kind"), "*") for n, p in both.items()])
    return {
        "distribution": class_distributions(manifest, classes), "overlaps": overlaps(manifest), "per_class": per_class,
            "weak_classes": metrics.threshold_report(per_class),
        "scores": scores, "confusion": metrics.normalised_confusion(dense), "top_confusions": metrics.top_confusions(predictions),
            "checks": metrics.audit_checks(dense),
    }


def require_selection_split(split: str, official: str = "validation", allowed: bool = False) -> None:
    """Refuse to select models on the official test split, unless it is allowed explicitly."""
    if split == official and not allowed:
        raise ValueError(f"{split!r} is the official test split: selecting on it would leak it. Choose an inner split of the training rows, or allow it explicitly.")


def leaky_hold_out(rows: DataFrame, classes, config: dict = NOTEBOOK, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Predictions of a stratified hold-out whose scaler has seen all rows: a diagnostic of what the leak is worth."""
    split = stage(folds.hold_out(rows, share, seed=seed), "leaky-rows")
    every = fitted.one_fold(split, split)
    scaled = stage(fitted.transformed(every, config["imputer"], config["scaler"]).where("is_test").select("id", "label", "domain", "features", "held_out"),
        "leaky-scaled")
    near = knn.neighbours(scaled.where("NOT held_out"), scaled.where("held_out"), int(config["k"]), config["metric"], float(config["p"]))
    out = knn.classify(knn.votes(near, scaled, config["weights"]), classes).withColumnRenamed("query_id", "id")
    return out.join(scaled.select("id", "label", "domain"), "id").withColumn("y_true_label", F.col("label"))


def notebook_evaluation(rows: DataFrame, classes, k: int = 5, group: str = "domain", config: dict = NOTEBOOK) -> dict[str, DataFrame]:
    """The same classifier on each domain and on all rows together, in stratified folds, beside the leaky hold-out.

    domains: (scope, status, reason, rows, scores' mean and deviation); a domain with fewer than two rows of one of its
    classes is skipped with the reason. All domains run in one plan: a fold belongs to a domain, and rows meet the train
    rows of their own domain only. leaky: scores of the hold-out with the leak, marked as such.
    """
    rows = rows.select("id", "label", "features", F.col(group).cast("string").alias("domain"))
    every = stage(rows.withColumn("scope", F.col("domain")).unionAll(rows.withColumn("scope", F.lit("combined"))), "notebook-rows")
    least = every.groupBy("scope", "label").agg(F.count("*").alias("n")).groupBy("scope").agg(F.sum("n").alias("rows"), F.min("n").alias("smallest"),
        F.count("*").alias("labels"), F.min_by("label", F.struct("n", "label")).alias("rarest"))
    able = (F.col("smallest") >= 2) & (F.col("labels") >= 2)
    reason = F.when(F.col("labels") < 2, "a single class").when(F.col("smallest") < 2, F.concat(F.lit("too few rows of "), "rarest"))
    status = stage(least.select("scope", "rows", F.when(able, "ok").otherwise("skipped").alias("status"), reason.alias("reason"), F.greatest(F.lit(2),
        F.least(F.lit(k), "smallest")).alias("k")), "notebook-scopes")
    numbered = status.where("status = 'ok'").withColumn("first", F.row_number().over(W.orderBy("scope")) * 1000)
    nth = F.row_number().over(W.partitionBy("scope", "label").orderBy(*folds.shuffled("id")))
    split = every.join(numbered, "scope").withColumn("fold", (F.col("first") + (nth - 1) % F.col("k")).cast("int"))
    of_scope = stage(split.select("id", "label", "domain", "features", "scope", "fold"), "notebook-folds")
    near = pipelines.neighbours(fitted.copies(of_scope, "fold", within="scope"), config, int(config["k"]))
    named = pipelines.classified(near, rows, classes, config).join(of_scope.select("fold", "scope").distinct(), "fold")
    by_fold = metrics.metrics(named, classes, ["scope", "fold"])
    scores = by_fold.groupBy("scope").agg(*[f(m).alias(f"{m}_{s}") for m in ("accuracy", "macro_precision", "macro_recall", "macro_f1",
        "weighted_f1") for s, f in (("mean", F.avg), ("std", F.stddev_pop))])
    leak = metrics.metrics(leaky_hold_out(rows, classes, config), classes).withColumn("leaky", F.lit(True))
    return {"domains": status.drop("k").join(scores, "scope", "left").orderBy("scope"), "leaky": leak}


def split_integrity(manifest: DataFrame) -> DataFrame:
    return leakage.leakage_counts(manifest)
