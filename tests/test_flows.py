import numpy as np
import pytest

from callgrid.operators import temporal
from callgrid.plans import pipelines
from callgrid.sources import images, sinks, wav
from callgrid.streaming import detections


def table(spark, n=90):
    r = np.random.default_rng(1)
    rows = [(i, f"c{i % 3}", f"d{i % 4}", (r.normal(size=4) + 2 * np.eye(4)[i % 3]).tolist(), i % 5 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label string, domain string, features array<double>, is_test boolean")


def test_submission_reports(spark):
    out = pipelines.submission(table(spark), ["c0", "c1", "c2"], {"scaler": "robust", "reducer": "pca:0.95", "k": 3}, {"c0": "x", "c1": "x"})
    assert out["predictions"].count() == 18 and out["summary"].first()["accuracy"] > 0.6
    assert {r["y_true_label"] for r in out["ambiguities"].collect()} <= {"c0", "c1"}


def test_failing_candidate_is_a_row(spark):
    rows = pipelines.evaluate(table(spark).drop("is_test"), ["c0", "c1", "c2"], [{"scaler": "none such"}, {"k": 1}, {"k": 3}])
    got = {r["candidate"]: r for r in pipelines.results(spark, rows).collect()}
    assert got[0]["status"] == "error" and "none such" in got[0]["error"] and got[0]["random_accuracy"] is None
    assert got[1]["status"] == got[2]["status"] == "ok" and got[2]["domain_macro_f1"] > 0.6


def test_images(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(np.sin(j)) for j in range(250)], 250, 0.1, 0.9, 10.0, 40.0) for i in range(3)],
        "id long, samples array<double>, rate int, clip_start_seconds double, clip_end_seconds double, low_frequency double, high_frequency double")
    cfg = {"sample_rate": 250, "n_fft": 64, "hop_length": 16, "n_mels": 16, "f_min": 0, "f_max": 125}
    paths = images.export(images.event_images(rows, cfg, 32), f"file://{tmp_path}/out").collect()
    assert len(paths) == 3
    got = images.read(spark, f"{tmp_path}/out").collect()
    assert {(r["height"], r["width"], r["channels"]) for r in got} == {(32, 32, 3)}


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    detections.to_table(detections.windowed_counts(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    batch = {(r["start"], r["event_type"]): r["n"] for r in detections.windowed_counts(source).collect()}
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got and all(batch[k] == n for k, n in got.items())  # windows the watermark hasn't closed yet are not out


def test_detection_flow(spark):
    events = spark.createDataFrame([("f", 0, 1.0, 3.0, "a", 10.0), ("f", 1, 5.0, 6.0, "b", 10.0)],
        "audio_path string, row int, start double, end double, label string, duration double")
    got = temporal.detect(events, "duration", "row", temporal.DetectorConfig(4.0, 0.5, 0.5, True, ("a", "b")), noise=0.0)
    assert [(r["start"], r["end"], r["label"]) for r in got.orderBy("start").collect()] == [(1.0, 3.0, "a"), (5.0, 6.0, "b")]


def test_cli_builds_a_manifest(spark, tmp_path, monkeypatch):
    from callgrid import cli

    (tmp_path / "train/annotations").mkdir(parents=True)
    (tmp_path / "train/audio/d").mkdir(parents=True)
    (tmp_path / "train/audio/d/2020-01-01T00-00-00_000.wav").write_bytes(wav.encode(np.zeros(500), 250))
    (tmp_path / "train/annotations/a.csv").write_text("dataset,filename,annotation,annotator,low_frequency,high_frequency,start_datetime,end_datetime\nd,2020-01-01T00-00-00_000.wav,bma,x,1,2,2020-01-01T00:00:00Z,2020-01-01T00:00:01Z\n")
    out = tmp_path / "out"
    cli.main(["build-manifest", "--data-root", str(tmp_path), "--out", str(out / "m"), "--quality-report", str(out / "q"), "--quality-summary",
        str(out / "s.csv"), "--split-distribution-dir", str(out / "r"), "--splits", "train"])
    assert spark.read.parquet(str(out / "m")).count() == 1 and (out / "r/class_distribution.csv").exists()
    cli.main(["check-splits", "--manifest", str(out / "m"), "--out", str(out / "leak.csv")])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "x string, y double")
    assert sinks.markdown(df) == "| x | y |\n| --- | --- |\n| a | 0.5000 |\n| b |  |\n"
    made = []
    make = lambda: made.append(1) or df
    for _ in range(2):
        assert sinks.cached(spark, f"{tmp_path}/cache", {"k": 1}, make).count() == 2
    assert len(made) == 1 and sinks.cache_summary(spark, f"{tmp_path}/cache").first()["files"] >= 1
    with pytest.raises(ValueError):
        sinks.clear_cache(spark, f"{tmp_path}/cache", True)
    assert abs(df.select(sinks.readme_score(sinks.F.lit("Macro-F1: 0.1 then Macro-F1: 0.25"))).first()[0] - 0.25) < 1e-9
