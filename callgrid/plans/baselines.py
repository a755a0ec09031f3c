"""The baseline comparison: models on representations, selected on inner rows of the training split, reported on the test.

All predictions of all models are one table; every metric of the report is a projection of one counted cube over it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrid.operators import fitted, folds, metrics, models, ranking
from callgrid.runtime import stage

FIT, SELECTION, TEST = "fit", "inner_validation", "official_held_out_test"


def compare(tables: dict, classes, names=models.MODELS, families: dict | None = None, pca: dict | None = None, share: float = 0.2, seed: int = 0,
    sizes: dict | None = None) -> dict[str, DataFrame]:
    """Report tables of a comparison. ``tables`` maps representations to (id, label, domain, features, is_test).

    Imputing, scaling and the optional PCA (components by representation) are fitted on the inner fit rows alone. results
    has a row per representation and model, best selection score first; test scores take no part in the order.
    """
    parts, widths = [], []
    for representation, table in tables.items():
        train, test = table.where("NOT is_test").drop("is_test"), table.where("is_test").drop("is_test")
        split, how = folds.selection_split(train, share, "domain", seed=seed)
        columns = ["id", "label", "domain", "features"]
        fit = split.where("NOT held_out").select(columns)
        rest = split.where("held_out").select(*columns, F.lit(SELECTION).alias("split_role")).unionAll(test.select(*columns, F.lit(TEST).alias("split_role")))
        both = fitted.one_fold(fit.withColumn("split_role", F.lit(FIT)), rest)
        reducer = f"pca:{pca[representation]}" if pca and pca.get(representation) else "none"
        filled = stage(fitted.impute(both, "median"), f"baseline-{representation}")  # its medians are found once for both
        ready = {s: stage(fitted.reduce(fitted.scale(filled, "standard" if s else "none"), reducer), f"baseline-{representation}")
            if s or reducer != "none" else filled for s in {models.needs_scaling(m) for m in names}}
        counts = ready[next(iter(ready))].groupBy("split_role").count().collect()
        n = {r["split_role"]: r["count"] for r in counts}
        widths.append((representation, table.select(F.size("features")).first()[0], n.get(FIT, 0), n.get(SELECTION, 0), n.get(TEST, 0), how))
        for m in names:
            own = ready[models.needs_scaling(m)]
            a, b = own.where("NOT is_test").drop("is_test", "fold"), own.where("is_test").drop("is_test", "fold")
            out = models.predictions(a, b, m, classes, seed, sizes, selection=b.where(F.col("split_role") == SELECTION))
            named = b.select("id", "domain", "split_role").join(out, "id").withColumns({"representation": F.lit(representation), "model": F.lit(m)})
            parts.append(stage(named, "baseline-predictions"))
    every = reduce(DataFrame.unionByName, parts).withColumn("dataset", F.col("domain"))
    key = ["representation", "model"]
    scores = metrics.metrics(every, classes, [*key, "split_role"])
    wanted = ("macro_f1", "balanced_accuracy", "accuracy")
    of = lambda role, prefix: scores.where(F.col("split_role") == role).select(*key, *[F.col(c).alias(f"{prefix}_{c}") for c in wanted])
    spark = every.sparkSession
    sizes_of = spark.createDataFrame(widths,
        "representation string, features_before_pipeline int, fit_rows long, selection_rows long, official_test_rows long, selection_method string")
    results = sizes_of.join(of(SELECTION, "selection"), "representation").join(of(TEST, "official_test"), key)
    test_rows = every.where(F.col("split_role") == TEST)
    out = {
        "predictions": every, "results": results, "comparison": ranking.compared(results, names),
            "per_class": metrics.per_class(metrics.confusion(test_rows, classes, key), key),
        "by_domain": metrics.metrics(test_rows, classes, [*key, "dataset"]), "confusion": metrics.confusion(test_rows, classes, key),
    }
    if families:
        from callgrid.functions.labels import aggregated

        grouped = test_rows.withColumns({x: aggregated(F.col(x), families) for x in ("y_true_label", "y_pred_label")})
        names_of = tuple(dict.fromkeys(families.get(x, x) for x in classes))
        by_family = metrics.metrics(grouped, names_of, key).select(*key, F.col("macro_f1").alias("official_test_family_macro_f1"))
        out["results"] = results = results.join(by_family, key)
        out |= {"family_by_domain": metrics.metrics(grouped, names_of, [*key, "dataset"]), "ambiguities": metrics.within_family_errors(test_rows, families)}
    out["results"] = stage(results, "baseline-results").orderBy(F.desc("selection_macro_f1"), *key)
    out["best"] = ranking.best_baseline(out["results"].withColumnRenamed("representation", "family")).withColumnRenamed("family", "representation")
    return out
