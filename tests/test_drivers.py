"""Fold-wise fitting, the search, the baselines, clustering, audits, images, sources and the command line, end to end."""

import json
import struct

import numpy as np
import pytest

from callgrid.functions import features as X
from callgrid.operators import clustering, fitted, folds, knn, metrics, models, prep, ranking
from callgrid.plans import audits, baselines, pipelines, search
from callgrid.sources import annotations, images, sinks, wav

CLASSES = ("c0", "c1", "c2")
SCHEMA = "id long, label string, domain string, features array<double>"


def table(spark, n=120, d=5, seed=1):
    r = np.random.default_rng(seed)
    rows = [(i, f"c{i % 3}", f"d{i % 4}", (r.normal(size=d) + 2.5 * np.eye(d)[i % 3]).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


# fitted steps

@pytest.mark.parametrize("scaler", fitted.SCALERS)
def test_steps_see_train_rows_only(spark, scaler):
    """Changing test rows changes nothing for the others; each fold equals a fit of its own."""
    rows, df = table(spark, 60)
    folded = folds.stratified(df, 3)
    got = {(r["fold"], r["id"]): r["features"] for r in fitted.scale(fitted.impute(fitted.copies(folded), "mean"), scaler).collect()}
    assert len(got) == 180
    fold_of = {r["id"]: r["fold"] for r in folded.collect()}
    spoilt = spark.createDataFrame([(i, y, g, [9.0 + k for k in range(5)] if fold_of[i] == 1 else x) for i, y, g, x in rows], SCHEMA)
    again = fitted.scale(fitted.impute(fitted.copies(folds.stratified(spoilt, 3)), "mean"), scaler)
    for r in again.where("fold = 1 AND NOT is_test").collect():
        assert np.allclose(r["features"], got[1, r["id"]])


def test_scalers_by_numpy(spark):
    rows, df = table(spark, 50)
    x = np.array([v for *_, v in rows])
    both = fitted.one_fold(df, df)

    def out(kind):
        return np.array([r["features"] for r in fitted.scale(both, kind).where("is_test").orderBy("id").collect()])

    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    assert np.allclose(out("standard"), (x - x.mean(0)) / x.std(0))
    assert np.allclose(out("robust"), (x - q[1]) / (q[2] - q[0]))
    assert np.allclose(out("standard_l2"), (lambda z: z / np.linalg.norm(z, axis=1)[:, None])((x - x.mean(0)) / x.std(0)))
    u = out("quantile_uniform")
    assert u.min() == 0 and u.max() == 1 and all((np.argsort(u[:, k]) == np.argsort(x[:, k])).all() for k in range(5))
    z = out("quantile_normal")
    inner = (u > 0.01) & (u < 0.99)
    from statistics import NormalDist

    assert np.allclose(z[inner], [NormalDist().inv_cdf(float(v)) for v in u[inner]], atol=0.01)
    p = out("power")
    assert np.allclose(p.mean(0), 0, atol=1e-9) and np.allclose(p.std(0), 1)
    for k in range(5):
        lam = min(np.linspace(-4, 6, 5001), key=lambda v: 0.5 * len(x) * np.log(prep.yeo_johnson(x[:, k], v).var()) - (v - 1) * (np.sign(x[:,
            k]) * np.log1p(np.abs(x[:, k]))).sum())
        y = prep.yeo_johnson(x[:, k], lam)
        assert np.allclose(p[:, k], (y - y.mean()) / y.std(), atol=0.02)


def test_reducers(spark):
    rows, df = table(spark, 90)
    x = np.array([v for *_, v in rows])
    both = fitted.one_fold(df, df)
    out = lambda kind: np.array([r["features"] for r in fitted.reduce(both, kind).where("is_test").orderBy("id").collect()])
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(np.abs(out("pca:2")), np.abs((x - x.mean(0)) @ vectors[:, ::-1][:, :2]))
    share = np.cumsum(values[::-1]) / values.sum()
    assert out("pca:0.7").shape[1] == int(np.searchsorted(share, 0.7) + 1)
    best = np.sort(np.argsort([-prep.mutual_information(x[:, k], np.array([r[1] for r in rows])) for k in range(5)], kind="stable")[:3])
    assert np.allclose(out("kbest:3"), x[:, best]) and out("kbest:99").shape[1] == 5
    assert np.allclose(out("variance:0.0"), x)
    near = lambda z: np.mean([rows[i][1] == rows[j][1] for i in range(90) for j in [np.argsort(((z - z[i]) ** 2).sum(1))[1]]])
    assert out("nca:2").shape == (90, 2) and near(out("nca:2")) >= near(out("pca:2")) - 0.02
    with pytest.raises(ValueError):
        fitted.reduce(both, "none such:1")


def test_mutual_information_by_pairs():
    r = np.random.default_rng(3)
    x, y = r.normal(size=150), r.integers(0, 3, 150)
    x = x + y
    noisy = x / x.std()
    noisy = noisy + 1e-10 * max(1.0, np.abs(noisy).mean()) * np.random.Generator(np.random.PCG64(0)).standard_normal(150)
    total = 0.0
    for i in range(150):
        radius = np.nextafter(np.sort(np.abs(noisy[y == y[i]] - noisy[i]))[3], 0)
        total += prep.digamma(3) - prep.digamma(int((y == y[i]).sum())) - prep.digamma(int((np.abs(noisy - noisy[i]) <= radius).sum()))
    assert abs(prep.mutual_information(x, y) - (prep.digamma(150) + total / 150)) < 1e-9


def test_cross_validation_equals_folds_one_by_one(spark):
    _, df = table(spark, 90)
    folded = folds.stratified(df, 3)
    config = {"scaler": "robust", "k": 3, "weights": "distance"}
    got = {r["id"]: r["y_pred_label"] for r in pipelines.cross_validate(folded, CLASSES, config).collect()}
    want = {}
    for f in range(3):
        want |= {r["id"]: r["y_pred_label"] for r in pipelines.predict(folded.where(f"fold <> {f}").drop("fold"), folded.where(f"fold = {f}").drop("fold"),
            CLASSES, config).collect()}
    assert got == want and len(got) == 90


def test_candidates_that_share_neighbours_score_alike(spark):
    _, df = table(spark, 90)
    together = pipelines.evaluated(df, CLASSES, [{"k": 1}, {"k": 5, "weights": "distance"}, {"k": 5}], "stratified")
    for c, scores in zip(({"k": 1}, {"k": 5, "weights": "distance"}, {"k": 5}), together, strict=True):
        assert pipelines.evaluated(df, CLASSES, [c], "stratified")[0] == pytest.approx(scores)


# search

SETTINGS = {
    "cv": {"n_splits": 2, "group_column": "domain"}, "limit_per_class": 30, "domain_cv_top_n": 1, "ablation": {"feature_sets": ["raw", "none such"], "k": 3},
    "stages": [
        {"name": "wide", "feature_sets": ["raw", "noise"], "scaler": ["standard"], "k": [1, 3], "max_candidates": 3},
        {"name": "deep", "feature_sets_from_previous_top": 1, "scaler": ["standard"], "reducer": ["none", "pca:2"], "k": [3], "weights": ["uniform",
            "distance"]},
    ],
}


def feature_maker(spark):
    _, raw = table(spark)
    r = np.random.default_rng(9)
    noise = spark.createDataFrame([(i, r.normal(size=4).tolist()) for i in range(120)], "id long, features array<double>")

    def make(rows, name):
        if name not in ("raw", "noise"):
            raise ValueError(f"unknown feature set {name}")
        return rows.join(raw.select("id", "features") if name == "raw" else noise, "id")

    return raw.drop("features"), make


def test_search_stages_and_reports(spark, tmp_path):
    rows, make = feature_maker(spark)
    out = search.run(rows, make, CLASSES, SETTINGS, domain_aware=False)
    got = out["results"].collect()
    stages = {r["stage"] for r in got}
    assert stages == {"wide", "deep", "ablation"} and {r["feature_set"] for r in got if r["stage"] == "deep"} == {"raw"}
    assert len([r for r in got if r["stage"] == "wide"]) == 3 and len([r for r in got if r["stage"] == "deep"]) == 4
    order = [(-r["random_weighted_f1"], -r["random_accuracy"]) for r in got]
    assert order == sorted(order)
    assert [r["feature_set"] for r in out["failed"].collect()] == ["none such"]
    assert {r["scenario"] for r in out["scenarios"].collect()} >= {"stratified", "leave_one_group_out"} and out["cv_metrics"].first()["accuracy"] > 0.7
    assert out["predictions"].count() == 90 and json.loads(out["strategy"].first()[0])["n_splits"] == 2


def test_search_modes(spark, tmp_path):
    assert [s["name"] for s in search.chosen_stages(SETTINGS, "1")] == ["wide"] and len(search.chosen_stages(SETTINGS, "full")) == 2
    quick = search.quick({"stages": [{"feature_sets": ["mfcc_13", "handcrafted_stats"], "k": [1, 2, 3, 4, 5], "max_candidates": 30}]})
    assert quick["stages"][0]["feature_sets"] == ["handcrafted_stats"] and quick["stages"][0]["k"] == [1, 2, 3,
        4] and quick["stages"][0]["max_candidates"] == 12 and quick["limit_per_class"] == 1000
    rows, make = feature_maker(spark)
    calls = []

    def counted(r, name):
        calls.append(name)
        return make(r, name)

    config = {"search": SETTINGS | {"stages": SETTINGS["stages"][:1], "ablation": {}}, "classes": list(CLASSES)}
    folder = search.run_to(rows, counted, CLASSES, config, str(tmp_path / "s"))
    best = json.loads(spark.read.text(f"{folder}/best_config").first()[0])
    assert best["knn"]["feature_set"] == "raw" and "Search" in "\n".join(r[0] for r in spark.read.text(f"{folder}/summary").collect())
    n = len(calls)
    assert search.run_to(rows, counted, CLASSES, config, folder, resume=True) == folder and len(calls) == n
    with pytest.raises(ValueError):
        search.run(rows, make, CLASSES, {"stages": []})


def test_submission_has_its_reports(spark, tmp_path):
    _, df = table(spark)
    rows = df.withColumn("is_test", df["id"] % 5 == 0)
    out = pipelines.submission(rows, CLASSES, {"scaler": "standard", "k": 3}, {"c0": "x", "c1": "x", "c2": "y"})
    assert len(out) >= 25
    p = out["predictions"].collect()
    assert len(p) == 24 and out["result"].first()["fit_rows"] == 96 and out["result"].first()["accuracy"] == np.mean([r["y_true_label"] == r["y_pred_label"] for r in p])
    wide = out["predictions_wide"].first()
    assert abs(sum(wide[f"prob_{c}"] for c in CLASSES) - 1) < 1e-9
    assert {r["correct"] for r in out["neighbours"].collect()} <= {True,
        False} and out["family_summary"].first()["accuracy"] >= out["summary"].first()["accuracy"]
    pipelines.save_model(rows.where("NOT is_test"), CLASSES, {"scaler": "standard", "k": 3}, str(tmp_path / "m"))
    train, classes, config = pipelines.load_model(spark, str(tmp_path / "m"))
    again = {r["id"]: r["y_pred_label"] for r in pipelines.predict(train, rows.where("is_test"), classes, config).collect()}
    assert again == {r["id"]: r["y_pred_label"] for r in p}


def test_older_configurations():
    got = pipelines.from_config({"knn": {"feature_set": "x", "scaler": "robust", "pca_components": 8, "model": {"n_neighbors": 7, "metric": "cosine"}}})
    assert got == {"feature_set": "x", "scaler": "robust", "k": 7, "metric": "cosine", "reducer": "pca:8"}
    assert pipelines.from_config({"knn": {"reducer": {"type": "select_k_best", "k": 64}}})["reducer"] == "kbest:64"
    assert pipelines.from_config({"knn": {"reducer": {"type": "none"}}})["reducer"] == "none"
    with pytest.raises(ValueError):
        pipelines.checked({"metric": "none such"})


# baselines

def test_baselines_of_all_models(spark):
    _, df = table(spark, 150)
    rows = df.withColumn("is_test", df["id"] % 5 == 0)
    small = {"trees": 5, "depth": 4, "rounds": 2, "lr_iterations": 20, "svm_iterations": 10, "mlp_iterations": 30, "hidden": 8}
    out = baselines.compare({"raw": rows}, CLASSES, families={"c0": "x", "c1": "x", "c2": "y"}, pca={"raw": 4}, sizes=small)
    got = out["results"].collect()
    assert {r["model"] for r in got} == set(models.MODELS)
    assert [r["selection_macro_f1"] for r in got] == sorted((r["selection_macro_f1"] for r in got), reverse=True)
    assert all(r["official_test_rows"] == 30 and r["fit_rows"] + r["selection_rows"] == 120 for r in got)
    assert np.mean([r["official_test_accuracy"] for r in got]) > 0.7 and out["best"].first()["model"] == min((r["model"] for r in got
        if r["selection_macro_f1"] == got[0]["selection_macro_f1"]))
    assert out["predictions"].count() == len(models.MODELS) * (30 + got[0]["selection_rows"])


def test_pruned_tree_prefers_small_trees(spark):
    rows, df = table(spark, 90)
    same = df.withColumn("label", df["label"]).limit(90)
    model, trials = models.pruned_tree(same, same, CLASSES, trials=((1, 0.0), (8, 0.0), (8, 10.0)))
    scores = {t[:2]: t for t in trials}
    assert scores[8, 0.0][2] >= scores[1, 0.0][2] and model.depth == min((t[3] for t in trials if t[2] == max(x[2] for x in trials)))


def test_gradient_free_models_are_refused(spark):
    _, df = table(spark, 30)
    with pytest.raises(ValueError):
        models.predictions(df, df, "none such", CLASSES)
    with pytest.raises(ValueError):
        models.predictions(df, df, "decision_tree_pruned", CLASSES)


# clustering

def test_silhouette_and_measures(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(40, 3)), r.normal(size=(30, 3)) + 6, r.normal(size=(1, 3)) + 30])
    label, cluster = ["a"] * 40 + ["b"] * 30 + ["c"], [0] * 40 + [1] * 30 + [2]
    rows = spark.createDataFrame([(i, label[i], x[i].tolist(), None if i == 5 else cluster[i]) for i in range(71)],
        "id long, label string, features array<double>, cluster long")
    got = {v["id"]: v["silhouette"] for v in clustering.silhouette(rows, block=16).collect()}
    assert len(got) == 70 and got[70] == 0
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    used = [i for i in range(71) if i != 5]
    for i in used[:-1]:
        own = [j for j in used if cluster[j] == cluster[i] and j != i]
        a, b = d[i, own].mean(), min(d[i, [j for j in used if cluster[j] == c]].mean() for c in {0, 1, 2} - {cluster[i]})
        assert abs(got[i] - (b - a) / max(a, b)) < 1e-9
    m = clustering.measures(rows, rows).first()
    assert m["clusters_found"] == 3 and abs(m["silhouette"] - np.mean(list(got.values()))) < 1e-9 and abs(m["ami"] - 1) < 1e-9 and abs(m["noise_fraction"] - 1 / 71) < 1e-9


def test_mean_shift_finds_modes(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(60, 2)) * 0.4 + c for c in ((0, 0), (5, 5), (0, 6))])
    rows = spark.createDataFrame([(i, f"c{i // 60}", x[i].tolist()) for i in range(180)], "id long, label string, features array<double>")
    got = clustering.mean_shift(rows, width=1.5).collect()
    assert len({(v["label"], v["cluster"]) for v in got}) == 3
    assert abs(clustering.bandwidth(x, 0.5) - np.mean([np.sort(np.sqrt(((x - v) ** 2).sum(1)))[89] for v in x])) < 1e-9


def test_exploring_clusters(spark):
    _, df = table(spark, 90)
    out = clustering.explore(df, 3, eps=1.5, least=4, seeds=2)
    assert {r["method"] for r in out["measures"].collect()} == {"kmeans", "dbscan", "mean_shift"} and out["assignments"].count() == 270


# audits

def test_notebook_evaluation(spark):
    _, df = table(spark, 120)
    lonely = spark.createDataFrame([(900, "c0", "lonely", [0.0] * 5), (901, "c1", "lonely", [1.0] * 5)], SCHEMA)
    out = audits.notebook_evaluation(df.unionAll(lonely), CLASSES, 3)
    got = {r["scope"]: r for r in out["domains"].collect()}
    assert set(got) == {"d0", "d1", "d2", "d3", "combined", "lonely"} and got["lonely"]["status"] == "skipped" and "c0" in got["lonely"]["reason"]
    config = audits.NOTEBOOK
    for scope in ("d1", "combined"):
        rows = df.unionAll(lonely) if scope == "combined" else df.where(f"domain = '{scope}'")
        folded = folds.stratified(rows, 3)
        scores = metrics.metrics(pipelines.cross_validate(folded, CLASSES, config), CLASSES, ["fold"]).agg({"accuracy": "avg"}).first()[0]
        assert abs(got[scope]["accuracy_mean"] - scores) < 1e-9
    assert out["leaky"].first()["leaky"] and 0 < out["leaky"].first()["accuracy"] <= 1


def test_selection_on_the_test_split_is_refused():
    audits.require_selection_split("train")
    audits.require_selection_split("validation", allowed=True)
    with pytest.raises(ValueError, match="official test"):
        audits.require_selection_split("validation")


def test_imbalance_audit(spark):
    from conftest import TESTDATA

    from callgrid.plans.queries import kept
    from callgrid.sources import tables as T

    out = audits.imbalance_audit(kept(spark, TESTDATA), T.predictions(spark, TESTDATA), T.VECTOR_CLASSES)
    assert {r["kind"] for r in out["scores"].collect()} == {"model", "majority", "permutation"} and out["checks"].first()["rows_sum_to_one"]
    assert {r["check"]: r["overlap"] for r in out["overlaps"].collect()}["dataset"] == 0


# sources

def chunked_wav(samples, rate, junk):
    body = b"".join(struct.pack("<4sI", name, len(data)) + data + b"\0" * (len(data) % 2) for name, data in ((b"LIST", junk), (b"fmt ",
        struct.pack("<HHIIHH", 3, 1, rate, 4 * rate, 4, 32)), (b"bext", junk), (b"data", np.asarray(samples, "<f4").tobytes())))
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def test_durations_reach_the_samples(spark, tmp_path):
    """Chunks of any length before the samples; files that are no WAV say why."""
    (tmp_path / "a.wav").write_bytes(chunked_wav(np.zeros(500), 250, b"x" * 9001))
    (tmp_path / "b.wav").write_bytes(wav.encode(np.zeros(250), 250))
    (tmp_path / "c.wav").write_bytes(b"RIFF")
    got = {r["audio_path"].rsplit("/", 1)[1]: r for r in wav.durations(spark, str(tmp_path)).collect()}
    assert (got["a.wav"]["duration"], got["b.wav"]["frames"]) == (2.0, 250) and got["c.wav"]["error"]
    samples = {r["audio_path"].rsplit("/", 1)[1]: r["samples"] for r in wav.waves(spark, str(tmp_path)).collect()}
    assert len(samples["a.wav"]) == 500 and samples["c.wav"] is None


HEADER = "dataset,filename,annotation,annotator,low_frequency,high_frequency,start_datetime,end_datetime"


def test_annotations_of_many_files_and_headers(spark, tmp_path):
    """Two kinds of header, one file without a column: two scans, rows numbered in each file, files in path order."""
    folder = tmp_path / "train/annotations"
    folder.mkdir(parents=True)
    for k in range(6):
        rows = [f"d,f{k},bma,x,{i},2,s{i},e" for i in range(k + 1)]
        text = [HEADER, *rows] if k % 2 else ["note," + HEADER, *("n," + r for r in rows)]
        (folder / f"a {k}.csv").write_text("\n".join(text) + "\n")
    (folder / "bad.csv").write_text("dataset,filename\nd,f\n")
    rows, issues = annotations.annotation_rows(spark, str(tmp_path), ["train"])
    got = sorted((r["file_rank"], r["source_row"], r["filename"], r["low_frequency"], r["start_datetime"]) for r in rows.collect())
    assert got == sorted((k, i, f"f{k}", float(i), f"s{i}") for k in range(6) for i in range(k + 1))
    assert [r["issue"].split(":")[0] for r in issues.collect()] == ["missing_columns"]
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count("Relation [") <= 4


def events(spark, n, files=1):
    rows = [(i, f"f{i % files}", 0.1 + 0.01 * (i % 50), 0.9 + 0.01 * (i % 50), 10.0, 60.0, "train", "bma" if i % 2 else "bmb") for i in range(n)]
    return spark.createDataFrame(rows,
        "id long, audio_path string, clip_start_seconds double, clip_end_seconds double, low_frequency double, high_frequency double, split string, label string")


CFG = {"sample_rate": 250, "n_fft": 64, "win_length": 64, "hop_length": 16, "n_mels": 16, "f_min": 0, "f_max": 125, "frequency_scale": "linear",
    "normalization": "sample"}


def wave_table(spark, files=1, n=2000):
    r = np.random.default_rng(8)
    return spark.createDataFrame([(f"f{k}", 250, [float(v) for v in r.normal(size=n)]) for k in range(files)],
        "audio_path string, rate int, samples array<float>")


def test_files_meet_their_events_once(spark):
    """The same vectors as with samples in every row; a file of 1,000 events is sent to as many tasks as wanted."""
    e, w = events(spark, 1000, 2), wave_table(spark, 2)
    got = {r["id"]: r["features"] for r in X.extract_from_files(e, w, "waveform_stats", CFG, per_task=150).collect()}
    assert len(got) == 1000
    few = e.where("id < 40")
    want = {r["id"]: r["features"] for r in X.extract(few.join(w, "audio_path"), "waveform_stats", CFG).collect()}
    assert all(np.allclose(got[i], v) for i, v in want.items())
    assert X.extract_from_files(e, w.limit(0), "waveform_stats", CFG).count() == 0


def test_representation_export(spark, tmp_path):
    e, w = events(spark, 24), wave_table(spark)
    for family, pca, n in (("patch", None, 64), ("hybrid", 3, 3 + 16), ("handcrafted", 2, 2)):
        path = f"{tmp_path}/{family}"
        X.export_representation(e, w, family, CFG, path, 8, pca)
        rows = spark.read.parquet(f"{path}/matrix").collect()
        names = json.loads(spark.read.json(f"{path}/about").first()["names"])
        assert len(rows) == 24 and {len(r["features"]) for r in rows} == {n} == {len(names)}


def test_panels_cache_and_error_images(spark, tmp_path):
    e, w = events(spark, 6), wave_table(spark)
    panels = images.crop_panels(e, w, CFG, 32)
    r = panels.orderBy("id").first()
    assert bytes(r["png"]).startswith(b"\x89PNG") and (r["start_seconds"], r["lowest_hz"] >= 10, r["highest_hz"] <= 60) == (0.1, True, True)
    predictions = spark.createDataFrame([(i, "a", "b" if i < 4 else "a", 0.5 + i / 10) for i in range(6)],
        "id long, y_true_label string, y_pred_label string, pred_confidence double")
    out = images.error_images(predictions, panels.select("id", "png"), f"file://{tmp_path}/errors", 3).collect()
    assert sorted(x["id"] for x in out) == [1, 2, 3]
    files = spark.createDataFrame([("f0", 8000, "2020")], "audio_path string, bytes long, modified string")
    root = f"{tmp_path}/tensors"
    first = images.cached_tensors(e, w, files, CFG, root, 16)
    assert first.count() == 6 and len(first.first()["tensor"]) == 3 * 16 * 16
    n = spark.read.parquet(root).count()
    assert images.cached_tensors(e, w, files, CFG, root, 16).count() == 6 and spark.read.parquet(root).count() == n
    images.cached_tensors(e, w, files.selectExpr("audio_path", "bytes + 1 AS bytes", "modified"), CFG, root, 16)
    assert spark.read.parquet(root).count() > n
    paths = images.export(panels.select("id", "png"), f"file://{tmp_path}/p").count()
    t = images.tensors(spark, f"{tmp_path}/p", 8).collect()
    assert paths == len(t) == 6 and {len(x["tensor"]) for x in t} == {192} and max(max(x["tensor"]) for x in t) <= 1.0
    dense = metrics.confusion(predictions, ("a", "b"))
    assert images.heatmap(dense, ("a", "b"), 4).startswith(b"\x89PNG")


def test_runs_and_reports(spark, tmp_path):
    for run, score, predictions in (("r1", 0.5, True), ("r2", 0.9, False), ("r3", None, True), ("r4", 0.7, True)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "best_metrics.json").write_text(json.dumps({"macro_f1": score, "x": 1} if score else {"x": 1}, indent=1))
        if predictions:
            (tmp_path / run / "val_predictions.csv").write_text("a\n1\n")
    got = [(r["run"].rsplit("/", 1)[1], r["macro_f1"], r["has_predictions"]) for r in sinks.run_table(spark, str(tmp_path)).collect()]
    assert got == [("r2", 0.9, False), ("r4", 0.7, True), ("r1", 0.5, True), ("r3", None, True)]
    assert sinks.latest_run(spark, str(tmp_path)).endswith("r4") and sinks.last_report(spark, str(tmp_path),
        "val_predictions.csv").endswith("r4/val_predictions.csv")
    with pytest.raises(FileNotFoundError):
        sinks.last_report(spark, str(tmp_path), "none.csv")
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(5), 4)


def test_scenarios_and_groups(spark):
    rows = spark.createDataFrame([(i, "a", "x", f"s{i % 3}") for i in range(9)], "id long, label string, domain string, site string")
    assert folds.group_column(rows) == "site" and folds.group_column(rows, "domain") == "site"
    assert folds.scenarios(rows, 3, "site") == ["leave_one_group_out", "stratified_groups", "group_folds", "stratified"]
    assert folds.scenarios(rows, 3, "site", "stratified_kfold")[0] == "stratified" and folds.scenarios(rows, 5, "site", most_groups=2) == ["stratified"]
    got = folds.stratified_groups(rows.withColumnRenamed("site", "g"), 3, "g")
    assert got.select("g", "fold").distinct().count() == 3


def test_neighbours_by_fold(spark):
    _, df = table(spark, 60)
    folded = fitted.copies(folds.stratified(df, 3))
    whole = knn.neighbours(folded.where("NOT is_test"), folded.where("is_test"), 4, by="fold", block=16).collect()
    assert len(whole) == 240
    for f in range(3):
        own = folded.where(f"fold = {f}")
        alone = {(r["query_id"], r["rank"]): r["neighbor_id"] for r in knn.neighbours(own.where("NOT is_test"), own.where("is_test"), 4).collect()}
        assert alone == {(r["query_id"], r["rank"]): r["neighbor_id"] for r in whole if r["fold"] == f}


def test_grid_has_no_repeats():
    got = ranking.grid({"feature_set": ["a", "b"], "metric": ["cosine", "minkowski"], "algorithm": ["brute", "kd_tree"], "p": [1, 2]})
    assert len(got) == len({json.dumps(c, sort_keys=True) for c in got}) and {c["feature_set"] for c in got[:2]} == {"a", "b"}
    assert not any(c["metric"] == "cosine" and c["algorithm"] == "kd_tree" for c in got) and all(c["p"] == 2 for c in got if c["metric"] != "minkowski")


# the command line

def test_commands_end_to_end(spark, tmp_path):
    from callgrid import api, cli

    lines = []
    for split, k in (("train", 12), ("validation", 6)):
        (tmp_path / "root" / split / "annotations").mkdir(parents=True)
        for i in range(k):
            name, site = f"2020-01-{i + 1:02d}T00-00-00_000.wav", f"s{i % 2 if split == 'train' else 9}"
            folder = tmp_path / "root" / split / "audio" / site
            folder.mkdir(parents=True, exist_ok=True)
            (folder / name).write_bytes(wav.encode(np.sin(2 * np.pi * (25 if i % 2 else 45) * np.arange(1000) / 250 + i), 250))
            lines += [f"{site},{name},{'bma' if i % 2 else 'bmb'},x,15,60,2020-01-{i + 1:02d}T00:00:0{a}Z,2020-01-{i + 1:02d}T00:00:0{a + 1}Z" for a in (0, 2)]
        (tmp_path / "root" / split / "annotations/a.csv").write_text("\n".join([HEADER, *lines]) + "\n")
        lines = []
    config = {"classes": ["bma", "bmb"], "audio": CFG, "knn": {"feature_set": "spectral_stats", "k": 1}, "clustering": {"per_class_limit": 20},
              "classical": {"representations": ["handcrafted"], "models": ["gaussian_nb"]},
              "search": {"cv": {"n_splits": 2}, "stages": [{"feature_sets": ["spectral_stats"], "k": [1, 3]}]}}
    (tmp_path / "c.yaml").write_text(json.dumps(config))
    root, m, c = str(tmp_path / "root"), str(tmp_path / "manifest"), str(tmp_path / "c.yaml")
    three = ["--manifest", m, "--config", c, "--data-root", root]
    cli.main(["regenerate", "--data-root", root, "--manifest", m, "--reports-root", str(tmp_path / "reports")])
    assert json.loads((tmp_path / "reports/provenance.json").read_text())["rows"] == {"manifest": 36, "issues": 0}
    for command, flag in (("submission", "--output-dir"), ("search", "--output-dir"), ("baselines", "--output-dir"), ("clustering", "--output-dir"),
         ("verify-crops", "--out"), ("spectrograms", "--out"), ("representations", "--out")):
        more = ["--cv-focused"] if command == "search" else ["--family", "handcrafted"] if command == "representations" else []
        cli.main([command, *three, flag, f"file://{tmp_path}/out/{command}", *more])
    out = f"file://{tmp_path}/out"
    assert spark.read.parquet(f"{out}/submission/summary").first()["accuracy"] == 1.0
    assert "- accuracy: 1.0000" in [r[0] for r in spark.read.text(f"{out}/submission/overview").collect()]
    assert "# Domain diagnostics" in [r[0] for r in spark.read.text(f"{out}/submission/domain_diagnostics").collect()]
    a, b = (sinks.manifest_signature(x) for x in (spark.read.parquet(m), spark.read.parquet(m).repartition(3)))
    assert a == b and a != sinks.manifest_signature(spark.read.parquet(m).limit(3))
    assert spark.read.parquet(f"{out}/search/results").count() == 2 and spark.read.parquet(f"{out}/verify-crops/extents").count() == 12
    cli.main(["audit", "--manifest", m, "--config", c, "--predictions", f"{out}/submission/predictions", "--out", f"{out}/audit"])
    cli.main(["inspect-errors", *three, "--predictions", f"{out}/submission/predictions", "--out", f"{out}/errors"])
    again = api.predict(f"{out}/submission/model", api.feature_table(api.events(api.manifest(m)).where("is_test"), root, "spectral_stats", CFG))
    assert {r["id"]: r["y_pred_label"] for r in again.collect()} == {r["id"]: r["y_pred_label"]
        for r in spark.read.parquet(f"{out}/submission/predictions").collect()}
