"""What a submission says beside its scores: confusions of stated pairs, class distributions, the split and its domains.

Every table is one aggregation of the rows; the texts are written from tables of a row per class, domain or pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrid.operators import metrics, profile
from callgrid.sources.sinks import markdown

# Names of the reports, their labels, and whether both directions count.
PAIRS = {"bpd_bmd_errors": ("bpd", "bmd", True), "bmb_bmz_errors": ("bmb", "bmz", False)}

TRAIN, TEST = "official_train", "official_held_out_test"


def pair_errors(predictions: DataFrame, classes, pairs: dict | None = None) -> dict[str, DataFrame]:
    """A report for each pair of declared classes."""
    return {name: metrics.pair_confusions(predictions, a, b, both) for name, (a, b, both) in (pairs or PAIRS).items() if {a, b} <= set(classes)}


def with_split(rows: DataFrame) -> DataFrame:
    return rows.withColumn("split", F.when(F.col("is_test"), TEST).otherwise(TRAIN))


def class_distributions(rows: DataFrame) -> dict[str, DataFrame]:
    """Counts and fractions of labels by split, and by split and domain, of (label, domain, is_test)."""
    own = with_split(rows).select("split", "domain", "label")
    return {"class_distribution_by_split": profile.distribution(own, within=["split"]),
        "class_distribution_by_domain": profile.distribution(own, within=["split", "domain"])}


def split_domains(rows: DataFrame) -> DataFrame:
    """(domain, train_rows, test_rows, labels, held_out): how the split divides each domain; held out is one without train rows."""
    out = rows.groupBy("domain").agg(F.count_if(~F.col("is_test")).alias("train_rows"), F.count_if("is_test").alias("test_rows"),
        F.count_distinct("label").alias("labels"))
    return out.withColumn("held_out", (F.col("train_rows") == 0))


def family_table(spark, families: dict) -> DataFrame:
    """(family, label) in the order of the mapping."""
    return spark.createDataFrame([(f, x) for x, f in families.items()], "family string, label string")


def submission_tables(rows: DataFrame, predictions: DataFrame, classes, families: dict | None = None, pairs: dict | None = None) -> dict[str, DataFrame]:
    out = pair_errors(predictions, classes, pairs) | class_distributions(rows) | {"split_domains": split_domains(rows)}
    return out | ({"family_mapping": family_table(rows.sparkSession, families)} if families else {})


def ambiguity_text(ambiguities: DataFrame, families: dict) -> str:
    """Errors that stay inside a family of labels, family by family, in Markdown."""
    found = ambiguities.collect()  # a row per pair of labels
    lines = ["# Confusions within families", "", "Labels of a family pass into each other, so these errors may lie in the annotations."]
    for family in dict.fromkeys(families.values()):
        own = sorted((-r["count"], r["y_true_label"], r["y_pred_label"]) for r in found if r["family"] == family)
        lines += ["", f"## {family}", "", "Labels: " + ", ".join(x for x, f in families.items() if f == family), ""]
        lines += [f"- {t} -> {p}: {-n}" for n, t, p in own] or ["No row of the family was taken for another label of it."]
    return "\n".join(lines) + "\n"


def diagnostics_text(tables: dict[str, DataFrame]) -> str:
    """Scores, domains, and how far the predicted classes are from the true ones, in Markdown."""
    r = tables["summary"].first()
    order = lambda name, *by: tables[name].orderBy(*by)
    parts = [("Domains of the split", order("split_domains", "domain")), ("Scores by domain", order("by_domain", "dataset").select("dataset", "support",
        "accuracy", "macro_f1")), ("Predicted and true classes", order("delta", "label"))]
    lines = ["# Domain diagnostics", "", f"- accuracy: {r['accuracy']:.4f}", f"- macro_f1: {r['macro_f1']:.4f}"]
    for title, t in parts:
        lines += ["", f"## {title}", "", markdown(t)]
    return "\n".join(lines)
