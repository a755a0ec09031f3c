"""Tables and texts of a submission beside its scores."""

import numpy as np

from callgrid.operators import metrics
from callgrid.plans import diagnostics, pipelines

CLASSES = ("bmb", "bmz", "bpd", "bmd")
FAMILIES = {"bmb": "ABZ", "bmz": "ABZ", "bmd": "DDswp", "bpd": "DDswp"}
SCHEMA = "id long, dataset string, y_true_label string, y_pred_label string, pred_confidence double"
ROWS = [(0, "d1", "bmb", "bmz", 0.5), (1, "d0", "bmb", "bmz", 0.4), (2, "d0", "bmz", "bmb", 0.9), (3, "d0", "bpd", "bmd", 0.6),
    (4, "d0", "bmd", "bpd", 0.8), (5, "d0", "bmd", "bmd", 0.7), (6, "d0", "bpd", "bmz", 0.7), (7, "d0", "bmb", "bmz", None), (8, "d0", None, "bmz", 0.1)]


def test_pairs_one_way_and_both_ways(spark):
    out = diagnostics.pair_errors(spark.createDataFrame(ROWS, SCHEMA), CLASSES)
    assert [r["id"] for r in out["bpd_bmd_errors"].collect()] == [4, 3]
    assert [r["id"] for r in out["bmb_bmz_errors"].collect()] == [1, 7, 0]  # by dataset, then the most confident; null last
    assert set(diagnostics.pair_errors(spark.createDataFrame(ROWS, SCHEMA), ("bpd", "bmd"))) == {"bpd_bmd_errors"}


def test_ambiguities_as_text(spark):
    text = diagnostics.ambiguity_text(metrics.within_family_errors(spark.createDataFrame(ROWS, SCHEMA), FAMILIES), FAMILIES)
    assert text.index("- bmb -> bmz: 3") < text.index("- bmz -> bmb: 1") < text.index("## DDswp") < text.index("- bpd -> bmd: 1")
    assert "bpd -> bmz" not in text
    none = diagnostics.ambiguity_text(metrics.within_family_errors(spark.createDataFrame(ROWS[5:6], SCHEMA), FAMILIES), FAMILIES)
    assert none.count("No row of the family") == 2


def test_distributions_and_domains(spark):
    rows = [("bmb", "a", False), ("bmb", "a", False), ("bmz", "a", True), ("bpd", "b", True), (None, "b", True), ("bmb", None, False)]
    df = spark.createDataFrame(rows, "label string, domain string, is_test boolean")
    by = diagnostics.class_distributions(df)
    got = {(r["split"], r["label"]): (r["count"], round(r["fraction"], 6)) for r in by["class_distribution_by_split"].collect()}
    assert got == {("official_train", "bmb"): (3, 1.0), ("official_held_out_test", "bmz"): (1, 0.333333), ("official_held_out_test", "bpd"): (1, 0.333333),
        ("official_held_out_test", None): (1, 0.333333)}
    assert sum(r["count"] for r in by["class_distribution_by_domain"].collect()) == 6
    domains = {r["domain"]: (r["train_rows"], r["test_rows"], r["labels"], r["held_out"]) for r in diagnostics.split_domains(df).collect()}
    assert domains == {"a": (2, 1, 2, False), "b": (0, 2, 1, True), None: (1, 0, 1, False)}
    assert diagnostics.split_domains(df.limit(0)).collect() == []


def test_a_submission_has_them(spark):
    r = np.random.default_rng(0)
    rows = [(i, CLASSES[i % 4], f"d{i % 3}", (r.normal(size=3) + np.eye(4)[i % 4][:3]).tolist(), i % 3 == 0) for i in range(72)]
    out = pipelines.submission(spark.createDataFrame(rows, "id long, label string, domain string, features array<double>, is_test boolean"), CLASSES,
        {"k": 3}, FAMILIES)
    p = out["predictions"].toPandas()
    pair = p[p.y_true_label.isin(["bpd", "bmd"]) & p.y_pred_label.isin(["bpd", "bmd"]) & (p.y_true_label != p.y_pred_label)]
    assert out["bpd_bmd_errors"].count() == len(pair)
    assert {(x["family"], x["label"]) for x in out["family_mapping"].collect()} == {(f, x) for x, f in FAMILIES.items()}
    assert [x["held_out"] for x in out["split_domains"].orderBy("domain").collect()] == [True, False, False]
    text = diagnostics.diagnostics_text(out)
    assert "## Domains of the split" in text and f"- accuracy: {(p.y_true_label == p.y_pred_label).mean():.4f}" in text
