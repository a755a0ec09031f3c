"""Classical baselines over ``pyspark.ml`` where the semantics agree; most are fitted on balanced weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callgrid.functions.labels import code
from callgrid.operators.boosting import boost
from callgrid.operators.kernel import fit_machines, kernel_map
from callgrid.operators.network import fit_network
from callgrid.operators.pruning import cost_complexity_tree

#: Names of the baselines. rbf_svm is exact up to as many rows as it has landmarks, and approximate beyond.
MODELS = ("logistic_regression", "linear_svm", "rbf_svm", "knn", "gaussian_nb", "decision_tree_pruned", "random_forest", "gradient_boosting", "mlp")
#: Sizes of the models; callers may lower them. Spark's trees end at depth 30.
SIZES = {"lr_iterations": 1000, "svm_iterations": 100, "trees": 200, "depth": 30, "rounds": 100, "hidden": 128, "mlp_iterations": 200}
#: C of the support vector machines.
HINGE = {"linear_svm": 1.0, "rbf_svm": 3.0}
#: Trials of a tree chosen by limits: depths and least information gains.
PRUNING = tuple((d, g) for d in (4, 8, 12, 20) for g in (0.0, 0.005, 0.02))


def needs_scaling(name: str) -> bool:
    return name in ("logistic_regression", "linear_svm", "rbf_svm", "knn", "mlp")


def balanced(rows: DataFrame, label: str = "label_idx") -> DataFrame:
    """Weight total / (classes x class count)."""
    counts = rows.groupBy(label).count()
    total = counts.agg(F.sum("count").alias("t"), F.count("*").alias("k")).first()
    weight = F.lit(float(total["t"] or 0)) / (F.lit(total["k"] or 1) * F.col("count"))
    return rows.join(counts.select(label, weight.alias("weight")), label)  # a row per class


def estimator(name: str, seed: int = 0, sizes: dict | None = None):
    from pyspark.ml import classification as C

    z = SIZES | (sizes or {})
    common = {"featuresCol": "vector", "labelCol": "label_idx", "predictionCol": "prediction"}
    if name == "logistic_regression":
        return C.LogisticRegression(maxIter=z["lr_iterations"], weightCol="weight", **common)
    if name == "gaussian_nb":
        return C.NaiveBayes(modelType="gaussian", **common)
    if name == "random_forest":
        return C.RandomForestClassifier(numTrees=z["trees"], maxDepth=z["depth"], featureSubsetStrategy="sqrt", seed=seed, weightCol="weight", **common)
    raise ValueError(f"unknown model {name!r}; known: {', '.join(MODELS)}")


def _ready(rows: DataFrame, classes) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumns({"label_idx": code(F.col("label"), classes).cast("double"), "vector": array_to_vector("features")})


def _named(out: DataFrame, classes) -> DataFrame:
    name = F.get(F.array(*[F.lit(c) for c in classes]), F.col("prediction").cast("int"))
    return out.select("id", F.col("label").alias("y_true_label"), name.alias("y_pred_label"))


def pruned_tree(train: DataFrame, selection: DataFrame, classes, seed: int = 0, trials=PRUNING):
    """A tree chosen among limits of its growth, where ``pruning`` has one chosen among its subtrees.

    (model, trials): the tree with the best macro-F1 on the selection rows; ties to the shallower, then the one with
    fewer leaves, then the larger least gain. trials: (depth limit, least gain, score, depth, leaves) of each."""
    from pyspark.ml.classification import DecisionTreeClassifier

    from callgrid.operators.metrics import metrics

    ready, judged, found = balanced(_ready(train, classes)).cache(), _ready(selection, classes).cache(), []
    for limit, gain in trials:
        tree = DecisionTreeClassifier(maxDepth=limit, minInfoGain=gain, seed=seed, featuresCol="vector", labelCol="label_idx", predictionCol="prediction",
            weightCol="weight")
        model = tree.fit(ready)
        score = metrics(_named(model.transform(judged), classes), classes).first()["macro_f1"]
        leaves = (model.numNodes + 1) // 2
        found.append(((-round(score, 9), model.depth, leaves, -gain), model, (limit, gain, score, model.depth, leaves)))
    ready.unpersist()
    judged.unpersist()
    return min(found, key=lambda x: x[0])[1], [x[2] for x in found]


def predictions(train: DataFrame, test: DataFrame, name: str, classes, seed: int = 0, sizes: dict | None = None, selection: DataFrame
    | None = None) -> DataFrame:
    """(id, y_true_label, y_pred_label) of the test rows; the tables are (id, label, features). ``selection`` is what the
    pruned tree is chosen on."""
    if name not in MODELS:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(MODELS)}")
    if name == "knn":
        from callgrid.operators import knn

        out = knn.classify(knn.votes(knn.neighbours(train, test, 5), train, "distance"), classes)
        return test.select("id", F.col("label").alias("y_true_label")).join(out.select(F.col("query_id").alias("id"), "y_pred_label"), "id")
    if name == "decision_tree_pruned":
        if selection is None:
            raise ValueError("the pruned tree needs selection rows")
        model, _ = cost_complexity_tree(train, selection, classes, seed)
        return _named(model.transform(_ready(test, classes)), classes)
    if name == "gradient_boosting":
        model = boost(_ready(train, classes), len(classes), (SIZES | (sizes or {}))["rounds"], seed=seed)
        return _named(model.transform(_ready(test, classes)), classes)
    if name == "mlp":
        z = SIZES | (sizes or {})
        model = fit_network(train.withColumn("label_idx", code(F.col("label"), classes)), len(classes), z["hidden"], z["mlp_iterations"], seed)
        return _named(model.transform(test.select("id", "label", "features")), classes)
    if name in ("linear_svm", "rbf_svm"):
        if name == "rbf_svm":
            features = kernel_map(train, seed=seed)
            train, test = features.apply(train), features.apply(test)
        iterations = (SIZES | (sizes or {}))["svm_iterations"]
        model = fit_machines(balanced(_ready(train, classes)), HINGE[name], iterations)
        return _named(model.transform(_ready(test, classes)), classes)
    model = estimator(name, seed, sizes).fit(balanced(_ready(train, classes)))
    return _named(model.transform(_ready(test, classes)), classes)
