"""The staged candidate search: stages that hand their best feature sets on, quick mode, resume, ablation, re-evaluation.

Everything is chosen on training rows. Candidates of one feature set and preprocessing share a neighbour search, folds are
a column; what comes to the driver is a row per candidate.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrid.operators import folds, metrics, ranking, sampling
from callgrid.plans import pipelines
from callgrid.runtime import stage
from callgrid.sources import sinks

PARAMETERS = ("imputer", "scaler", "reducer", "k", "weights", "metric", "p")
# What quick mode prefers and keeps at most, and the ablation's candidate and feature sets.
QUICK_SETS = ("handcrafted_stats", "waveform_spectral_stats", "notebook_lowfreq_band_features", "relative_lowfreq_shape_features",
    "temporal_lowfreq_shape_features")
QUICK_MOST = {"k": 4, "metric": 2, "reducer": 3, "scaler": 3}
QUICK_CANDIDATES, QUICK_ROWS = 12, 1000
ABLATION = {"imputer": "median", "scaler": "robust_l2", "reducer": "none", "k": 1, "weights": "uniform", "metric": "cosine", "p": 2}
ABLATION_SETS = (
    "waveform_spectral_stats", "handcrafted_stats", "notebook_lowfreq_band_features", "relative_lowfreq_shape_features", "temporal_lowfreq_shape_features",
    "lowfreq_relative_temporal", "lowfreq_all", "lowfreq_all_plus_mfcc", "lowfreq_all_plus_logmel", "lowfreq_all_plus_waveform_spectral",
)


def quick(settings: dict) -> dict:
    """Smaller settings: fewer rows a class, short grids, few candidates."""
    stages = []
    for s in settings.get("stages", []):
        own = dict(s)
        if own.get("feature_sets"):
            own["feature_sets"] = [n for n in QUICK_SETS if n in own["feature_sets"]] or list(own["feature_sets"])[:3]
        own |= {p: list(own[p])[:n] for p, n in QUICK_MOST.items() if p in own}
        own["max_candidates"] = min(int(own.get("max_candidates", 30)), QUICK_CANDIDATES)
        stages.append(own)
    return settings | {"stages": stages, "limit_per_class": int(settings.get("limit_per_class") or QUICK_ROWS)}


def chosen_stages(settings: dict, wanted: str = "full") -> list[dict]:
    """Stage 1 alone, stages 1 and 2, or all."""
    if wanted not in ("1", "2", "3", "full"):
        raise ValueError(f"unknown stage {wanted!r}; known: 1, 2, 3, full")
    stages = list(settings.get("stages", []))
    return stages[: int(wanted)] if wanted in "12" else stages


def stage_candidates(settings: dict, prior: DataFrame | None, keys, seed: int) -> list[dict]:
    """The grid of a stage over its own feature sets, or over the best of the stage before."""
    top = settings.get("feature_sets_from_previous_top")
    if top and prior is not None:
        names = [r["feature_set"] for r in ranking.top_feature_sets(prior.where("status = 'ok'"), int(top), keys).collect()]
    else:
        names = list(settings.get("feature_sets", []))
    spec = {"feature_set": names} | {p: list(settings.get(p, [pipelines.DEFAULT[p]])) for p in PARAMETERS}
    return ranking.grid(spec, seed, settings.get("max_candidates"))


def domain_scenario(rows: DataFrame, cv: dict) -> tuple[list[str], str]:
    """(scenarios that the rows allow, the one that ranks domains)."""
    group = folds.group_column(rows, cv.get("group_column", "domain"))
    primary = "stratified_kfold" if str(cv.get("primary", "domain_aware")) in ("stratified", "stratified_kfold") else None
    found = folds.scenarios(rows, int(cv.get("n_splits", 4)), group, primary, int(cv.get("max_leave_one_group_splits", 12)))
    return found, found[0]


def run(rows: DataFrame, features, classes, settings: dict, domain_aware: bool = True, wanted: str = "full", seed: int = 0) -> dict[str, DataFrame]:
    """Result tables of a search. ``features(rows, name)`` gives the feature table (id, label, domain, features) of a set.

    results: all candidates that worked, best first; failed: the others; families: the best candidate of each feature set;
    ablation: one candidate over many feature sets; scenarios: the best candidates in every scenario; predictions and
    cv_metrics: the winner's pooled folds; strategy: how rows were split.
    """
    spark, cv, keys = rows.sparkSession, settings.get("cv", {}), pipelines.ranking_keys(domain_aware)
    if limit := settings.get("limit_per_class"):
        order = [c for c in ("dataset", "filename", "source_row", "id") if c in rows.columns]
        rows = sampling.first_n(rows, ["label"], order, int(limit))
    rows = stage(rows, "search-rows")
    n, found = int(cv.get("n_splits", 4)), domain_scenario(rows, cv)
    group = folds.group_column(rows, cv.get("group_column", "domain")) or "domain"
    tables: dict = {}

    def table(name: str) -> DataFrame:
        if name not in tables:
            tables[name] = stage(features(rows, name), f"search-{name}")
        return tables[name]

    def evaluate(candidates: list[dict], first: int, of: str) -> list[dict]:
        by: dict = {}
        for c in candidates:
            by.setdefault(c["feature_set"], []).append(c)
        out: list[dict] = []
        for name, own in by.items():
            try:
                out += pipelines.evaluate(table(name), classes, own, first + len(out), n, group, ("stratified", found[1]))
            except ValueError as e:  # a feature set that doesn't exist
                out += [{"candidate": first + len(out) + i, "feature_set": name, "params": json.dumps(c, sort_keys=True), "status": "error",
                    "error": str(e)[:200]} for i, c in enumerate(own)]
        return [r | {"stage": of} for r in out]

    every: list[dict] = []
    prior, limit = None, settings.get("max_candidates")
    for i, s in enumerate(chosen_stages(settings, wanted), 1):
        candidates = stage_candidates(s, prior, keys, seed + i)[: None if limit is None else max(0, int(limit) - len(every))]
        got = evaluate(candidates, len(every), s.get("name", f"stage_{i}"))
        every += got
        prior = pipelines.results(spark, got) if got else prior
    if not every:
        raise ValueError("no search stage is configured")
    ablation: list[dict] = []
    if names := settings.get("ablation", {}).get("feature_sets", ()):
        template = ABLATION | {k: v for k, v in settings["ablation"].items() if k in PARAMETERS}
        ablation = evaluate([template | {"feature_set": x} for x in names], len(every), "ablation")
    stages = spark.createDataFrame([(r["candidate"], r["stage"]) for r in every + ablation], "candidate long, stage string")
    scored = stage(pipelines.results(spark, every + ablation).join(stages, "candidate"), "search-results")
    ok = scored.where("status = 'ok'")
    best = [json.loads(r["params"]) for r in ranking.top(ok, int(settings.get("domain_cv_top_n", 5)), keys).collect()]
    out = {"results": ranking.ranked(ok, keys), "failed": scored.where("status <> 'ok'"), "families": ranking.best_per_feature_set(ok, keys)}
    out["ablation"] = ranking.ranked(scored.where("stage = 'ablation'"), keys)
    strategy = {"scenarios": found[0], "domain_scenario": found[1], "ranking_scenario": found[1] if domain_aware else "stratified", "group_column": group,
        "n_splits": n, "rows": "official training split only"}
    out["strategy"] = spark.createDataFrame([(json.dumps(strategy, sort_keys=True),)], "strategy string")
    if not best:
        return out
    again = []
    for name in dict.fromkeys(c["feature_set"] for c in best):
        own = [(place, c) for place, c in enumerate(best, 1) if c["feature_set"] == name]
        for s in found[0]:
            for (place, c), scores in zip(own, pipelines.evaluated(table(name), classes, [c for _, c in own], s, n, group), strict=True):
                values = [scores.get(f"{m}{x}") for m in pipelines.SCORES for x in ("", "_std", "_worst")]
                again.append((place, s, name, json.dumps(c, sort_keys=True), scores.get("error"), *values))
    columns = ", ".join(f"{m}{x} double" for m in pipelines.SCORES for x in ("", "_std", "_worst"))
    out["scenarios"] = spark.createDataFrame(again, f"place int, scenario string, feature_set string, params string, error string, {columns}")
    won = pipelines.scenario_rows(table(best[0]["feature_set"]), strategy["ranking_scenario"], n, group)
    out["predictions"] = stage(pipelines.cross_validate(stage(won, "search-won"), classes, best[0]), "search-predictions")
    out["cv_metrics"] = metrics.metrics(out["predictions"], classes)
    return out


def finished(spark: SparkSession, folder: str) -> bool:
    """Whether a search has left its results in a folder, so that it need not run again."""
    from callgrid.sources.sinks import exists

    return all(exists(spark, f"{folder}/{name}/_SUCCESS") for name in ("results", "best_config"))


def run_to(rows: DataFrame, features, classes, config: dict, folder: str, quick_mode: bool = False, resume: bool = False, domain_aware: bool = True,
    wanted: str = "full", max_candidates: int | None = None) -> str:
    """Run a search and write its tables, the winner's configuration and a summary under a folder of a shared store.
    ``max_candidates``: of all stages together; a smaller number in the configuration holds."""
    spark = rows.sparkSession
    if resume and finished(spark, folder):
        return folder
    settings = quick(config.get("search", {})) if quick_mode else config.get("search", {})
    limits = [int(x) for x in (settings.get("max_candidates"), max_candidates) if x is not None]
    settings = settings | ({"max_candidates": min(limits)} if limits else {})
    out = run(rows, features, classes, settings, domain_aware, wanted, int(config.get("seed", 0)))
    for name, t in out.items():
        t.write.mode("overwrite").parquet(f"{folder}/{name}")
    first = out["results"].first()
    if first is None:
        raise ValueError(f"all candidates failed; their reasons are in {folder}/failed")
    best = {k: v for k, v in config.items() if k != "search"} | {"knn": json.loads(first["params"])}
    lines = [summary_text(out, domain_aware)]
    spark.createDataFrame([(json.dumps(best, sort_keys=True),)], "config string").coalesce(1).write.mode("overwrite").text(f"{folder}/best_config")
    spark.createDataFrame([(x,) for x in lines], "line string").coalesce(1).write.mode("overwrite").text(f"{folder}/summary")
    return folder


def summary_text(out: dict[str, DataFrame], domain_aware: bool) -> str:
    """The search in Markdown: the split, the winner, the ten best, the best of each feature set."""
    columns = ["candidate", "stage", "feature_set", "random_accuracy", "random_weighted_f1", "random_macro_f1", "domain_accuracy", "domain_macro_f1",
        "domain_accuracy_worst"]
    strategy = json.loads(out["strategy"].first()[0])
    keys = pipelines.ranking_keys(domain_aware)
    parts = ["# Search", "", f"- candidates: {out['results'].count()}", f"- ranking: {'domains first' if domain_aware else 'stratified folds first'}"]
    parts += [f"- {k}: {v}" for k, v in strategy.items()] + ["", "## Best", "", sinks.markdown(ranking.top(out["results"], 10, keys).select(*columns))]
    parts += ["## By feature set", "", sinks.markdown(ranking.ranked(out["families"], keys).select(*columns, "n_candidates"))]
    if not out["ablation"].isEmpty():
        parts += ["## Ablation", "", sinks.markdown(out["ablation"].where(F.col("status") == "ok").select("feature_set", "feature_dimension", *columns[3:]))]
    return "\n".join(parts)
