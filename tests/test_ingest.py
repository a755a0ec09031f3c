import numpy as np
import pytest

from callgrid.operators import ingest, leakage
from callgrid.sources import annotations, config, wav


def write(root, rows, name="tiny", split="train", header=None):
    folder = root / split / "annotations"
    folder.mkdir(parents=True, exist_ok=True)
    columns = header or ["dataset", "filename", "annotation", "annotator", "low_frequency", "high_frequency", "start_datetime", "end_datetime"]
    (folder / f"{name}.csv").write_text("\n".join([",".join(columns), *[",".join(map(str, r)) for r in rows]]) + "\n")


def audio(root, name="2020-01-01T00-00-00_000.wav", seconds=2.0, split="train", dataset="tiny"):
    folder = root / split / "audio" / dataset
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(wav.encode(np.zeros(int(250 * seconds)), 250))


def row(start, end, label="bma", name="2020-01-01T00-00-00_000.wav"):
    return ["tiny", name, label, "test", 10.0, 20.0, f"2020-01-01T00:00:{start:09.6f}+00:00", f"2020-01-01T00:00:{end:09.6f}+00:00"]


def test_kept_duplicate_and_late_event(spark, tmp_path):
    audio(tmp_path)
    write(tmp_path, [row(0.5, 1.5), row(0.5, 1.5, "Bm-A"), row(3.0, 4.0), row(0.1, 0.2), row(1.5, 3.0), row(0.2, 0.2), row(0.0, 1.0, "zzz"), row(0.0, 1.0,
        "bmb", "2020-01-01T01-00-00_000.wav")])
    write(tmp_path, [["x", "y"]], "short", header=["dataset", "filename"])
    manifest, issues = annotations.build_manifest(spark, str(tmp_path), ["train"])
    kept = {r["source_row"]: r for r in manifest.collect()}
    assert set(kept) == {0, 4}
    assert kept[0]["quality_status"] == "ok" and kept[4]["quality_status"] == "clipped_end" and kept[4]["clip_end_seconds"] == 2.0
    found = {r["row"]: r["issue"] for r in issues.collect()}
    assert found[1] == "duplicate_event" and found[2] == "start_after_audio_end" and found[3] == "too_little_audio"
    assert found[5] == "non_positive_duration" and found[6].startswith("unknown_label_alias") and found[7] == "missing_audio"
    assert found[None].startswith("missing_columns:annotation,annotator,end_datetime")


@pytest.mark.parametrize("raw, label", [("bma", "bma"), (" Bm-A ", "bma"), ("BP_40 down", "bpd"), ("Bp-20Plus", "bp20plus"), ("zzz", None), (None, None)])
def test_aliases(spark, raw, label):
    from pyspark.sql import functions as F

    from callgrid.functions.labels import normalised

    assert spark.createDataFrame([(raw,)], "x string").select(normalised(F.col("x"))).first()[0] == label


def test_leakage_is_raised(spark):
    cols = "split string, dataset string, filename string, audio_path string, label string, start_seconds double, end_seconds double, source_row long"
    rows = spark.createDataFrame([("train", "d", "f", "p", "a", 0.0, 1.0, 1), ("validation", "d", "f", "p", "a", 0.0, 1.0, 1), ("train", "d", "g", "q",
        None, 0.0, 1.0, 2)], cols)
    assert {r["check"]: r["leaked_rows"] for r in leakage.leakage_counts(rows).collect()} == {"event": 1, "audio_path": 1, "file": 1, "source_row": 1}
    with pytest.raises(ValueError, match="leakage"):
        leakage.require_no_leakage(rows)


@pytest.mark.parametrize("tag, bits, kind, scale", [(1, 16, "<i2", 2**15), (1, 32, "<i4", 2**31), (3, 32, "<f4", 1), (3, 64, "<f8", 1)])
def test_wav_formats(tag, bits, kind, scale):
    import struct

    x = np.array([0.5, -0.25, 0.0, 0.125])
    data = (x * scale).astype(kind).tobytes()
    head = b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, tag, 2, 250, 0, 0, bits) + b"data" + struct.pack("<I",
        len(data))
    got, rate = wav.decode(head + data)
    assert rate == 250 and got.shape == (2, 2) and np.allclose(got.ravel(), x)


def test_wav_source(spark, tmp_path):
    audio(tmp_path)
    (tmp_path / "bad.wav").write_bytes(b"no audio")
    got = {r["audio_path"].rsplit("/", 1)[1]: r for r in wav.durations(spark, str(tmp_path)).collect()}
    assert got["2020-01-01T00-00-00_000.wav"]["duration"] == 2.0 and got["bad.wav"]["error"]
    assert {len(r["samples"] or []) for r in wav.waves(spark, str(tmp_path)).collect()} == {500, 0}


def test_config(tmp_path):
    (tmp_path / "base.yaml").write_text("audio: {n_fft: 64, normalization: global, margin_seconds: 1}\na: {b: 1, c: 2}\n")
    (tmp_path / "child.yaml").write_text("extends: base.yaml\naudio: {preset: aplose_256_90, n_mels: 8}\na: {c: 3}\n")
    c = config.load(str(tmp_path / "child.yaml"))
    assert c["a"] == {"b": 1, "c": 3} and "n_fft" not in c["audio"] and c["audio"]["normalization"] == "global"
    assert config.with_preset(c["audio"])["n_fft"] == 256 and config.with_preset(c["audio"])["n_mels"] == 8
    with pytest.raises(ValueError):
        config.with_preset({"preset": "no"})
    assert config.stable_hash({"b": 1, "a": 2}) == config.stable_hash({"a": 2, "b": 1})


def test_valid_rows_reads_text(spark):
    rows = spark.createDataFrame([("True", "train"), ("false", "train"), ("true", "validation")], "valid_event string, split string")
    assert ingest.valid_rows(rows, ["train"]).count() == 1


def test_a_parent_from_the_working_folder(tmp_path, monkeypatch):
    from callgrid.sources import config

    (tmp_path / "own").mkdir()
    (tmp_path / "base.yaml").write_text("a: {b: 1, c: 2}\n")
    (tmp_path / "own/child.yaml").write_text("extends: base.yaml\na: {c: 3}\n")
    monkeypatch.chdir(tmp_path)
    assert config.load(str(tmp_path / "own/child.yaml")) == {"a": {"b": 1, "c": 3}}
    (tmp_path / "own/base.yaml").write_text("a: {b: 7}\n")
    assert config.load(str(tmp_path / "own/child.yaml")) == {"a": {"b": 7, "c": 3}}
