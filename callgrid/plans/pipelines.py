"""End-to-end flows over feature tables (id, label, domain, features): fit, classify, cross-validate, evaluate, report."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrid.operators import fitted, folds, knn, metrics
from callgrid.operators.ranking import CV_FOCUSED, DOMAIN_AWARE, ranked
from callgrid.plans import diagnostics
from callgrid.runtime import stage

DEFAULT = {"imputer": "mean", "scaler": "standard", "reducer": "none", "k": 5, "weights": "uniform", "metric": "euclidean", "p": 2}
#: What decides the neighbours of a candidate; the rest only decides the vote.
SEARCHED = ("imputer", "scaler", "reducer", "metric", "p")
SCORES = ("accuracy", "macro_precision", "macro_f1", "weighted_f1")


def checked(config: dict) -> dict:
    """The configuration with its defaults; unknown names are an error."""
    c = DEFAULT | config
    reducer = str(c["reducer"]).partition(":")[0]
    for name, value, known in (("scaler", c["scaler"], fitted.SCALERS), ("reducer", reducer, fitted.REDUCERS), ("metric", c["metric"], knn.METRICS),
        ("imputer", c["imputer"], ("mean", "median")), ("weights", c["weights"], ("uniform", "distance"))):
        if value not in known:
            raise ValueError(f"unknown {name} {value!r}; known: {', '.join(known)}")
    if int(c["k"]) < 1:
        raise ValueError(f"k must be at least 1, not {c['k']}")
    return c


def from_config(config: dict) -> dict:
    """Classifier settings of a configuration file: its knn part, nested or flat, and the older key for PCA components."""
    own = dict(config.get("knn") or {})
    model, reducer = own.pop("model", None) or {}, own.pop("reducer", None)
    flat = own | model
    if "n_neighbors" in flat:
        flat["k"] = flat.pop("n_neighbors")
    if isinstance(reducer, dict):
        kind, value = reducer.get("type", "none"), next((reducer[x] for x in ("n_components", "k", "threshold", "variance") if reducer.get(x) is not None),
            None)
        kind = {"variance_threshold": "variance", "select_k_best": "kbest", "pca_variance": "pca"}.get(kind, kind)
        reducer = kind if value is None or kind == "none" else f"{kind}:{value}"
    if reducer is None and (n := flat.pop("pca_components", None)):
        reducer = f"pca:{n}"
    return flat | ({"reducer": reducer} if reducer else {})


def neighbours(table: DataFrame, config: dict, k: int) -> DataFrame:
    """(fold, query_id, rank, neighbor_id, distance) of the test rows of fold copies, every step fitted on train rows."""
    c = checked(config)
    ready = stage(fitted.transformed(table, c["imputer"], c["scaler"], c["reducer"]).select("fold", "is_test", "id", "features"), "flow-ready")
    return knn.neighbours(ready.where("NOT is_test"), ready.where("is_test"), k, c["metric"], float(c["p"]), by="fold", staged=True)


def classified(near: DataFrame, rows: DataFrame, classes, config: dict) -> DataFrame:
    """Predictions from neighbours with ranks: (fold, id, label, domain, y_pred_label, pred_confidence, probs, ...)."""
    c = checked(config)
    voted = knn.votes(near.where(F.col("rank") <= int(c["k"])), rows, c["weights"], by=["fold"])
    out = knn.classify(voted, classes, by=["fold"]).withColumnRenamed("query_id", "id").join(rows.select("id", "label", "domain"), "id")
    return metrics.with_true_probability(out.withColumn("y_true_label", F.col("label")))


def predict(train: DataFrame, test: DataFrame, classes, config: dict) -> DataFrame:
    """(id, label, domain, y_pred_label, pred_confidence, probs, y_true_label, true_probability) of the test rows."""
    columns = ["id", "label", "domain", "features"]
    near = neighbours(fitted.one_fold(train.select(columns), test.select(columns)), config, int(checked(config)["k"]))
    return classified(near, train.select(columns).unionAll(test.select(columns)), classes, config).drop("fold")


def cross_validate(rows: DataFrame, classes, config: dict, fold: str = "fold") -> DataFrame:
    """Pooled predictions of all folds, with the fold of each; one plan for all folds."""
    near = neighbours(fitted.copies(rows, fold), config, int(checked(config)["k"]))
    return classified(near, rows, classes, config)


def fold_scores(near: DataFrame, rows: DataFrame, classes, candidates: dict[int, dict]) -> dict[int, dict]:
    """Mean, population deviation and worst fold of each score, for candidates that share their neighbours: one plan, with
    the candidate as a column. A fold's macro scores cover the classes that occur in it."""
    settings = [F.struct(F.lit(i).alias("candidate"), F.lit(int(checked(c)["k"])).alias("k"), F.lit(checked(c)["weights"]).alias("weights")) for i,
        c in candidates.items()]
    key = ["candidate", "fold"]
    asked = near.withColumn("c", F.explode(F.array(*settings))).where(F.col("rank") <= F.col("c.k")).select("c.candidate", "c.weights", *near.columns)
    found = knn.classify(knn.votes(asked, rows, F.col("weights"), by=key), classes, by=key).withColumnRenamed("query_id", "id")
    named = found.join(rows.select("id", F.col("label").alias("y_true_label")), "id")
    by = metrics.metrics(named, classes, key).withColumn("macro_f1", F.col("macro_f1_fold"))
    scores = [f(m).alias(f"{m}{s}") for m in SCORES for s, f in (("", F.avg), ("_std", F.stddev_pop), ("_worst", F.min))]
    return {r["candidate"]: {k: v for k, v in r.asDict().items() if k != "candidate"} for r in by.groupBy("candidate").agg(*scores).collect()}


def scenario_rows(rows: DataFrame, scenario: str, k: int, group: str, seed: int = 0) -> DataFrame:
    """Rows with the fold of a scenario."""
    if scenario == "stratified":
        return folds.stratified(rows, folds.safe_k(rows, k), seed=seed)
    if scenario == "leave_one_group_out":
        return folds.leave_one_group_out(rows, group)
    if scenario == "stratified_groups":
        return folds.stratified_groups(rows, k, group)
    if scenario == "group_folds":
        return folds.group_folds(rows, k, group)
    raise ValueError(f"unknown scenario {scenario!r}")


def evaluated(rows: DataFrame, classes, candidates: list[dict], scenario: str, k: int = 3, group: str = "domain") -> list[dict]:
    """Scores of each candidate in a scenario, in their order.

    Candidates that differ only in the vote share one neighbour search, for the largest k of them; smaller ones read the
    first ranks. A candidate that its data or its configuration don't allow is a result with the reason; a failure of the
    engine is raised.
    """
    out: list[dict] = [{} for _ in candidates]
    groups: dict = {}
    for i, c in enumerate(candidates):
        try:
            groups.setdefault(tuple(str(checked(c)[x]) for x in SEARCHED), []).append(i)
        except ValueError as e:
            out[i] = {"error": str(e)}
    if not groups:
        return out
    table = stage(scenario_rows(rows, scenario, k, group), "cv-rows")
    for own in groups.values():
        try:
            most = max(int(checked(candidates[i])["k"]) for i in own)
            near = stage(neighbours(fitted.copies(table), candidates[own[0]], most), "cv-neighbours")
        except (ValueError, AnalysisException) as e:
            for i in own:
                out[i] = {"error": str(e)[:200]}
            continue
        for i, scores in fold_scores(near, table, classes, {i: candidates[i] for i in own}).items():
            out[i] = scores
    return out


RESULT = ["candidate long", "feature_set string", "params string", "status string", "error string", "feature_dimension long"]
RESULT += [f"{s}_{m}{x} double" for s in ("random", "domain") for m in SCORES for x in ("", "_std", "_worst")]


def results(spark, rows: list[dict]) -> DataFrame:
    """Search results as a table; scores that are missing are null."""
    names = [c.split()[0] for c in RESULT]
    plain = [tuple(float(r[n]) if r.get(n) is not None and t == "double" else r.get(n) for n, t in (c.split() for c in RESULT)) for r in rows]
    return spark.createDataFrame(plain, ", ".join(RESULT)).select(*names)


def evaluate(rows: DataFrame, classes, candidates: list[dict], first: int = 0, k: int = 3, group: str = "domain", scenarios: tuple = ("stratified",
    "group_folds")) -> list[dict]:
    """Result rows of candidates of one feature set, under a random and a domain scenario; equal scenarios run once."""
    scored = {s: evaluated(rows, classes, candidates, s, k, group) for s in dict.fromkeys(scenarios)}
    width = rows.select(F.size("features")).first()
    out = []
    for i, c in enumerate(candidates):
        found = [scored[s][i] for s in scenarios]
        error = next((x["error"] for x in found if "error" in x), None)
        row = {"candidate": first + i, "feature_set": str(c.get("feature_set", "")), "params": json.dumps(c, sort_keys=True, default=str),
            "status": "error" if error else "ok", "error": error, "feature_dimension": width and width[0]}
        if not error:
            row |= {f"{name}_{m}": v for name, x in zip(("random", "domain"), found, strict=True) for m, v in x.items()}
        out.append(row)
    return out


def ranking_keys(domain_aware: bool) -> tuple:
    return DOMAIN_AWARE if domain_aware else tuple((f"random_{c}", up) for c, up in CV_FOCUSED)


def search(tables: dict, classes, candidates: list[dict], domain_aware: bool = False, k: int = 3) -> DataFrame:
    """All candidates, best first. ``tables`` maps feature-set names to feature tables, computed once."""
    rows, spark = [], next(iter(tables.values())).sparkSession
    by: dict = {}
    for c in candidates:
        by.setdefault(c["feature_set"], []).append(c)
    for name, own in by.items():
        rows += evaluate(tables[name], classes, own, len(rows), k)
    return ranked(results(spark, rows), ranking_keys(domain_aware))


def evaluation(p: DataFrame, classes, families: dict | None = None) -> dict[str, DataFrame]:
    """All report tables that follow from stored predictions (id, dataset, y_true_label, y_pred_label, probs, pred_confidence,
    true_probability). A class that no row is or is given has a curve of its scores with a recall of 0."""
    dense, by_domain = metrics.confusion(p, classes), metrics.confusion(p, classes, ["dataset"])
    per_class = metrics.per_class(dense)
    score = lambda c: F.coalesce(F.try_element_at("probs", F.lit(c)), F.lit(0.0))
    against_rest = F.inline(F.array(*[F.struct(F.lit(c).alias("label"), score(c).alias("score"), F.coalesce(F.col("y_true_label") == c,
        F.lit(False)).alias("positive")) for c in classes]))
    curves = metrics.pr_curve(p.select(against_rest))
    out = {
        "predictions_wide": metrics.with_class_columns(p, classes), "confusion": dense, "confusion_matrix": metrics.confusion_table(dense, classes),
        "confusion_normalised": metrics.normalised_confusion(dense), "per_class": per_class, "report": metrics.report_rows(per_class),
        "thresholds": metrics.threshold_report(per_class), "summary": metrics.summary(per_class), "by_domain": metrics.metrics(p, classes, ["dataset"]),
        "by_domain_class": metrics.per_class(by_domain, ["dataset"]), "top_confusions": metrics.top_confusions(p),
        "delta": metrics.predicted_vs_true(p, classes), "confidence": metrics.confidence_analysis(p, classes), "errors": metrics.errors(p),
        "majority": metrics.metrics(metrics.majority_baseline(p, classes), classes),
        "permutation": metrics.metrics(metrics.permutation_baseline(p, "id"), classes), "audit": metrics.audit_checks(dense),
        "pr_curves": curves.drop("ap_part"), "average_precision": curves.groupBy("label").agg(F.sum("ap_part").alias("average_precision")),
    }
    if families:
        from callgrid.functions.labels import aggregated

        grouped = p.withColumns({x: aggregated(F.col(x), families) for x in ("y_true_label", "y_pred_label")})
        names = tuple(dict.fromkeys(families.get(x, x) for x in classes))
        counted = metrics.confusion(grouped, names)
        out |= {"ambiguities": metrics.within_family_errors(p, families), "family_summary": metrics.metrics(grouped, names),
            "family_per_class": metrics.per_class(counted), "family_confusion": metrics.confusion_table(counted, names),
            "family_by_domain": metrics.metrics(grouped, names, ["dataset"])}
    return out


def submission(rows: DataFrame, classes, config: dict, families: dict | None = None) -> dict[str, DataFrame]:
    """Report tables of a classifier fitted on the rows that are not test: those of its predictions, its neighbours and its
    settings. One neighbour search serves all of them."""
    c = checked(config)
    train, test = (rows.where(x).select("id", "label", "domain", "features") for x in ("NOT is_test", "is_test"))
    near = stage(neighbours(fitted.one_fold(train, test), c, int(c["k"])), "submission-neighbours")
    p = stage(classified(near, rows, classes, c).drop("fold").withColumn("dataset", F.col("domain")), "submission-predictions")
    report = knn.neighbour_report(near.drop("fold"), train).withColumnRenamed("query_id", "id")
    report = report.join(p.select("id", "y_true_label", "y_pred_label", (F.col("y_true_label") == F.col("y_pred_label")).alias("correct")), "id")
    counts = rows.agg(F.count_if(~F.col("is_test")).alias("fit_rows"), F.count_if("is_test").alias("official_test_rows"),
        F.max(F.size("features")).alias("features_before_pipeline"))
    out = {"predictions": p} | evaluation(p, classes, families) | {"neighbours": report, "neighbour_distances": knn.distance_stats(report)}
    out |= diagnostics.submission_tables(rows, p, classes, families)
    # one row each: the configuration beside the scores
    settings = [F.lit(str(c[x])).alias(x) for x in DEFAULT]
    out["result"] = counts.crossJoin(out["summary"]).select(*settings, "*")
    return out


def overview(tables: dict[str, DataFrame], feature_set: str = "") -> str:
    """A submission in Markdown: its settings, its scores, each domain's scores."""
    from callgrid.sources.sinks import markdown

    r = tables["result"].first()
    lines = ["# Submission", "", f"- feature set: {feature_set}", *[f"- {x}: {r[x]}" for x in (*DEFAULT, "fit_rows", "official_test_rows",
        "features_before_pipeline")]]
    lines += [f"- {m}: {r[m]:.4f}" for m in ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")]
    by = tables["by_domain"].select("dataset", "support", "accuracy", "macro_f1", "weighted_f1").orderBy("dataset")
    return "\n".join([*lines, "", "## By domain", "", markdown(by)])


def save_model(rows: DataFrame, classes, config: dict, path: str) -> None:
    """A classifier as files: its training rows and its configuration. Its fitted statistics follow from them."""
    spark = rows.sparkSession
    rows.select("id", "label", "domain", "features").write.mode("overwrite").parquet(f"{path}/train")
    about = json.dumps({"classes": list(classes), "config": checked(config)}, sort_keys=True)
    spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(spark, path: str):
    """(training rows, classes, configuration) of a saved classifier, as ``predict`` takes them."""
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return spark.read.parquet(f"{path}/train"), about["classes"], about["config"]
