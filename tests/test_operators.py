import numpy as np
import pytest

from callgrid.operators import clustering, folds, knn, metrics, models, prep, ranking, sampling, temporal


def frame(spark, y_true, y_pred):
    return spark.createDataFrame(list(zip(y_true, y_pred, strict=True)), "y_true_label string, y_pred_label string")


def test_metrics_by_hand(spark):
    m = metrics.metrics(frame(spark, ["a", "a", "b", "b"], ["a", "b", "b", "b"]), ["a", "b", "absent"]).first()
    assert m["accuracy"] == 0.75 and m["balanced_accuracy"] == 0.75
    assert abs(m["macro_f1"] - 0.48889) < 1e-4 and abs(m["present_macro_f1"] - 0.73333) < 1e-4


def test_metrics_of_nothing(spark):
    m = metrics.metrics(frame(spark, [], []).limit(0), ["a", "b"]).first()
    assert m["accuracy"] == 0 and m["macro_f1"] == 0


def test_permutation_keeps_the_multiset(spark):
    p = spark.createDataFrame([(i, f"c{i % 7}", "x") for i in range(500)], "id long, y_true_label string, y_pred_label string")
    got = metrics.permutation_baseline(p, "id").collect()
    assert len(got) == 500 and sorted(r["y_true_label"] for r in got) == sorted(r["y_pred_label"] for r in got)
    assert any(r["y_true_label"] != r["y_pred_label"] for r in got)


def test_global_rank(spark):
    rows = spark.createDataFrame([(int(i),) for i in np.random.default_rng(1).permutation(1000)], "id long")
    assert all(r["id"] == r["at"] for r in sampling.global_rank(rows, [rows["id"]], "at").collect())


@pytest.mark.parametrize("metric, p", [("euclidean", 2), ("manhattan", 2), ("cosine", 2), ("chebyshev", 2), ("minkowski", 3)])
def test_neighbours_in_blocks(spark, metric, p):
    x = np.random.default_rng(3).normal(size=(60, 5)).round(1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    got = {}
    for r in knn.neighbours(rows, rows, 4, metric, p, exclude_self=True, block=17).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["neighbor_id"]))
    d = np.round(knn.distances(x, x, metric, p), knn.DIGITS)
    np.fill_diagonal(d, np.inf)
    for i in range(60):
        assert [n for _, n in sorted(got[i])] == np.lexsort((np.arange(60), d[i]))[:4].tolist()


def test_zero_distance_votes_alone(spark):
    near = spark.createDataFrame([(1, 1, 10, 0.0), (1, 2, 11, 1.0), (1, 3, 12, 1.0)], "query_id long, rank int, neighbor_id long, distance double")
    labels = spark.createDataFrame([(10, "a"), (11, "b"), (12, "b")], "id long, label string")
    assert knn.classify(knn.votes(near, labels, "distance"), ["a", "b"]).first()["y_pred_label"] == "a"
    assert knn.classify(knn.votes(near, labels), ["a", "b"]).first()["y_pred_label"] == "b"


def test_impute_and_scale(spark):
    rows = spark.createDataFrame([(0, [1.0, float("nan")]), (1, [3.0, 2.0]), (2, [5.0, 4.0])], "id long, features array<double>")
    stats = prep.fetched(prep.statistics(rows))
    assert [r["mean"] for r in stats] == [3.0, 3.0]
    probe = spark.createDataFrame([([1000.0, float("inf")],)], "features array<double>")
    assert probe.select(prep.impute(probe["features"], stats)).first()[0] == [1000.0, 3.0]
    assert abs(stats[0]["std"] - np.std([1, 3, 5])) < 1e-12


def test_pca_matches_numpy(spark):
    x = np.random.default_rng(5).normal(size=(50, 4)) @ np.diag([3, 2, 1, 0.1])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    stats = prep.fetched(prep.statistics(rows))
    cov = prep.covariance(rows, stats)
    assert np.allclose(cov, np.cov(x.T, bias=True))
    parts, share = prep.principal_components(cov, variance=0.9)
    assert share.sum() >= 0.9 and len(parts) < 4
    got = np.array([r[0] for r in rows.orderBy("id").select(prep.projected(rows["features"], stats, parts)).collect()])
    assert np.allclose(got, (x - x.mean(0)) @ parts.T)


def test_yeo_johnson_makes_symmetric():
    x = np.exp(np.random.default_rng(6).normal(size=400))
    y = prep.yeo_johnson(x, prep.yeo_johnson_lambda(x))
    assert abs(((y - y.mean()) ** 3).mean() / y.std() ** 3) < 0.2


def test_mutual_information_orders_features():
    r = np.random.default_rng(7)
    y = r.integers(0, 3, 300)
    assert prep.mutual_information(y + r.normal(0, 0.1, 300), y) > prep.mutual_information(y + r.normal(0, 2, 300),
        y) > prep.mutual_information(r.normal(size=300), y) - 0.1


def test_islands_and_empty_input(spark):
    rows = [("f", i, 1 if i in (0, 1, 2, 3, 7, 9, 10) else 0, 0.9 if i != 10 else 0.4) for i in range(12)]
    frames = spark.createDataFrame(rows, "audio_path string, frame long, pred int, confidence double")
    got = [(r["start"], r["end"]) for r in temporal.islands(frames, temporal.DetectorConfig(4.0, 0.5)).orderBy("start").collect()]
    assert got == [(0.0, 1.0)]
    assert temporal.islands(frames.limit(0), temporal.DetectorConfig()).count() == 0


def test_no_second_choice_in_matching(spark):
    t = spark.createDataFrame([("f", 0, 0.0, 10.0), ("f", 1, 9.0, 19.0)], "audio_path string, gt_id long, start double, end double")
    d = spark.createDataFrame([("f", 0, 0.0, 10.0), ("f", 1, 1.0, 11.0)], "audio_path string, pred_id long, start double, end double")
    got = temporal.file_summary(d, t, [0.5]).first()
    assert (got["tp"], got["fp"], got["fn"]) == (1, 1, 1)


def test_overlap_across_buckets(spark):
    t = spark.createDataFrame([("f", 0, 0.0, 2000.0)], "audio_path string, gt_id long, start double, end double")
    d = spark.createDataFrame([("f", 0, 100.0, 1900.0)], "audio_path string, pred_id long, start double, end double")
    assert [round(r["iou"], 6) for r in temporal.overlaps(d, t).collect()] == [0.9]


def test_folds(spark):
    rows = spark.createDataFrame([(i, f"l{i % 3}", f"g{i % 5}") for i in range(150)], "id long, label string, domain string")
    f = folds.stratified(rows, 5).groupBy("fold", "label").count().collect()
    assert len(f) == 15 and {r["count"] for r in f} == {10}
    assert folds.group_folds(rows, 3, "domain").select("domain", "fold").distinct().count() == 5
    assert folds.stratified_groups(rows, 2, "domain").select("domain", "fold").distinct().count() == 5
    assert folds.group_column(rows) == "domain" and folds.safe_k(rows, 80) == 50
    assert folds.hold_out(rows, 0.2).where("held_out").groupBy("label").count().count() == 3


def test_grid():
    spec = {"feature_set": ["a", "b"], "metric": ["cosine", "minkowski", "euclidean"], "algorithm": ["brute", "kd_tree"], "p": [1, 2, 3]}
    g = ranking.grid(spec)
    assert not any(c["metric"] == "cosine" and c["algorithm"] == "kd_tree" for c in g)
    assert len({str(sorted(c.items())) for c in g}) == len(g) == 2 * (1 + 6 + 2)
    assert {c["feature_set"] for c in ranking.grid(spec, limit=2)} == {"a", "b"} and g == ranking.grid(spec)


def test_dbscan(spark):
    r = np.random.default_rng(8)
    x = np.concatenate([r.normal(0, 0.1, (30, 2)), r.normal(3, 0.1, (30, 2)), [[10.0, 10.0]]])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    got = {q["id"]: q["cluster"] for q in clustering.dbscan(rows, 0.5, 5, axes=2).collect()}
    assert len({got[i] for i in range(30)}) == 1 and len({got[i] for i in range(30, 60)}) == 1 and got[0] != got[30] and got[60] is None


def test_cluster_measures(spark):
    perfect = spark.createDataFrame([(0, "a"), (0, "a"), (1, "b"), (1, "b"), (None, "b")], "cluster int, label string")
    m = clustering.contingency_measures(perfect).first()
    assert all(abs(m[k] - 1) < 1e-9 for k in ("homogeneity", "completeness", "nmi", "ari")) and abs(m["noise_fraction"] - 0.2) < 1e-9
    assert abs(clustering.adjusted_mutual_information(np.array([[2, 0], [0, 2]])) - 1) < 1e-9


@pytest.mark.parametrize("name", ["logistic_regression", "gaussian_nb", "random_forest"])
def test_baselines_learn(spark, name):
    r = np.random.default_rng(9)
    rows = spark.createDataFrame([(i, f"c{i % 2}", (r.normal(size=3) + 3 * (i % 2)).tolist()) for i in range(120)],
        "id long, label string, features array<double>")
    out = models.predictions(rows.where("id % 5 <> 0"), rows.where("id % 5 = 0"), name, ["c0", "c1"], sizes={"trees": 50, "depth": 8})
    assert metrics.metrics(out, ["c0", "c1"]).first()["accuracy"] > 0.9
