"""WAV by byte ranges: cut and streamed files, blocks, clips of events, and which files are opened."""

import os
import struct

import numpy as np
import pytest

from callgrid import api
from callgrid.functions import features as X
from callgrid.sources import annotations, wav

CFG = {"sample_rate": 250, "n_fft": 64, "win_length": 64, "hop_length": 16, "n_mels": 16, "f_min": 0, "f_max": 125, "frequency_scale": "linear",
    "normalization": "sample"}
HEADER = "dataset,filename,annotation,annotator,low_frequency,high_frequency,start_datetime,end_datetime"


def pcm(samples, rate, tag=1, bits=16, channels=1, stated=None, junk=b""):
    """A WAV file; ``stated`` is what its data chunk says of its size."""
    kind = {(1, 8): "u1", (1, 16): "<i2", (1, 32): "<i4", (3, 32): "<f4", (3, 64): "<f8"}.get((tag, bits))
    data = np.asarray(samples).astype(kind).tobytes() if kind else b"".join(struct.pack("<i", v)[:3] for v in np.ravel(samples).tolist())
    width = channels * bits // 8
    about = struct.pack("<HHIIHH", tag, channels, rate, rate * width, width, bits)
    body = b"fmt " + struct.pack("<I", 16) + about + (b"LIST" + struct.pack("<I", len(junk)) + junk if junk else b"")
    return b"RIFF" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + body + b"data" + struct.pack("<I", len(data) if stated is None else stated) + data


def named(rows):
    out = {}
    for r in rows:
        out.setdefault(r["audio_path"].rsplit("/", 1)[1], []).append(r)
    return out


def test_cut_and_streamed_files_have_the_length_of_their_samples(spark, tmp_path):
    whole = wav.encode(np.arange(1000) / 1000, 250)
    (tmp_path / "cut.wav").write_bytes(whole[: 44 + 4 * 100 + 3])
    (tmp_path / "stream.wav").write_bytes(pcm(np.arange(700), 250, stated=0xFFFFFFFF))
    (tmp_path / "none.wav").write_bytes(whole[:44])
    (tmp_path / "more.wav").write_bytes(whole + b"LIST\x02\0\0\0xx")
    got = {k: v[0] for k, v in named(wav.durations(spark, str(tmp_path)).collect()).items()}
    assert {k: v["frames"] for k, v in got.items()} == {"cut.wav": 100, "stream.wav": 700, "none.wav": 0, "more.wav": 1000}
    assert got["cut.wav"]["duration"] == 0.4 and got["none.wav"]["duration"] == 0
    samples = named(wav.waves(spark, str(tmp_path)).collect())
    assert all(len(samples[k][0]["samples"]) == v["frames"] for k, v in got.items())


def test_events_behind_the_end_of_a_cut_file_are_issues(spark, tmp_path):
    folder = tmp_path / "train/audio/d"
    folder.mkdir(parents=True)
    (tmp_path / "train/annotations").mkdir()
    (folder / "2020-01-01T00-00-00_000.wav").write_bytes(wav.encode(np.zeros(1000), 250)[: 44 + 4 * 400])
    lines = [f"d,2020-01-01T00-00-00_000.wav,bma,x,1,2,2020-01-01T00:00:0{a}Z,2020-01-01T00:00:0{a + 1}Z" for a in range(4)]
    (tmp_path / "train/annotations/a.csv").write_text("\n".join([HEADER, *lines]) + "\n")
    rows, issues = annotations.build_manifest(spark, str(tmp_path), ("train",))
    assert {(r["start_seconds"], r["clip_end_seconds"]) for r in rows.collect()} == {(0.0, 1.0), (1.0, 1.6)}
    assert {(r["row"], r["issue"]) for r in issues.collect()} == {(2, "start_after_audio_end"), (3, "start_after_audio_end")}


@pytest.mark.parametrize(("tag", "bits", "channels"), [(1, 8, 1), (1, 16, 2), (1, 24, 1), (1, 24, 3), (1, 32, 1), (3, 32, 2), (3, 64, 1)])
def test_blocks_equal_decoded_files(spark, tmp_path, tag, bits, channels):
    """Every frame in one block, whatever the ranges; a long file is several tasks."""
    r = np.random.default_rng(bits)
    top = {8: 256, 16: 2**15, 24: 2**23, 32: 2**31}.get(bits, 1)
    for k, n in enumerate((0, 1, 999, 5000)):
        values = r.normal(size=(n, channels)) if tag == 3 else r.integers(0 if bits == 8 else -top, top, (n, channels))
        (tmp_path / f"f{k}.wav").write_bytes(pcm(values, 250, tag, bits, channels, junk=b"j" * 200))
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"x")
    df = wav.blocks(spark, str(tmp_path), range_bytes=1001)
    assert df.rdd.getNumPartitions() >= 5000 * channels * bits // 8 // 1001
    got = named(df.collect())
    assert set(got) == {"f1.wav", "f2.wav", "f3.wav", "bad.wav", "empty.wav"} and all(got[k][0]["error"] and len(got[k]) == 1 for k in ("bad.wav", "empty.wav"))
    for k in (1, 2, 3):
        rows = sorted(got[f"f{k}.wav"], key=lambda x: x["first"])
        whole, rate = wav.decode((tmp_path / f"f{k}.wav").read_bytes())
        ends = np.cumsum([len(x["samples"]) for x in rows]).tolist()
        assert [x["first"] for x in rows] == [0, *ends[:-1]] and ends[-1] == len(whole) == rows[0]["frames"]
        assert np.array_equal(np.concatenate([x["samples"] for x in rows]).astype(np.float32), whole.mean(1).astype(np.float32))
        assert all((x["start_seconds"], x["end_seconds"]) == (x["first"] / rate, (x["first"] + len(x["samples"])) / rate) for x in rows)


def test_filters_of_blocks_choose_what_is_read(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan, StringContains

    for k in range(4):
        (tmp_path / f"{k}.wav").write_bytes(wav.encode(np.arange(10_000), 250))

    def reader(*filters):
        out = wav.BlockReader({"path": str(tmp_path), "rangebytes": "1000"})
        left = list(out.pushFilters(list(filters)))
        ranges = [p for part in out.partitions() for p in part.ranges]
        return left, {p[0].rsplit("/", 1)[1] for p in ranges}, [b for part in out.partitions() for b in out.read(part)]

    path = ("audio_path",)
    assert reader(EqualTo(path, f"{tmp_path}/1.wav"))[:2] == ([], {"1.wav"})
    assert reader(In(path, (f"{tmp_path}/1.wav", f"{tmp_path}/3.wav")), StringContains(path, "3"))[:2] == ([], {"3.wav"})
    times = [GreaterThan(("end_seconds",), 10.0), LessThan(("start_seconds",), 12.0), EqualTo(path, f"{tmp_path}/2.wav")]
    left, _, blocks = reader(*times)
    assert left == times[:2]
    assert 500 <= sum(len(b.column(6)[0]) for b in blocks) <= 510  # two seconds and a frame at each side


def test_filters_reach_the_source(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.wav").write_bytes(wav.encode(np.arange(2000) + k, 250))
    df = wav.blocks(spark, str(tmp_path), range_bytes=4000)
    got = df.where(f"audio_path = '{tmp_path}/1.wav' AND end_seconds > 2 AND start_seconds < 3").select("first", "samples").collect()
    x = {r["first"] + i: v for r in got for i, v in enumerate(r["samples"])}
    assert all(x[i] == i + 1 for i in range(500, 750)) and len(x) < 1000
    assert df.where(f"audio_path <> '{tmp_path}/1.wav'").select("audio_path").distinct().count() == 2


def event_rows(spark, folder, files, seconds):
    r = np.random.default_rng(3)
    rows = [(i, f"{folder}/{i % files}.wav", float(a), float(a + d), float(d), 10.0, 60.0)
        for i, (a, d) in enumerate(zip(r.uniform(-0.2, seconds, 60), r.uniform(0.1, 3, 60), strict=True))]
    return spark.createDataFrame(rows, "id long, audio_path string, clip_start_seconds double, clip_end_seconds double, duration_seconds double, "
        "low_frequency double, high_frequency double")


@pytest.mark.parametrize("rate", [250, 1000, 96, 441])
def test_clips_give_the_vectors_of_whole_files(spark, tmp_path, rate):
    """Also where the rate changes, at both ends of a file and behind its end."""
    r = np.random.default_rng(rate)
    for k in range(2):
        (tmp_path / f"{k}.wav").write_bytes(wav.encode(r.normal(size=rate * 20 + k), rate))
    (tmp_path / "2.wav").write_bytes(b"no audio")
    events, cfg = event_rows(spark, tmp_path, 4, 21), CFG | {"margin_seconds": 0.5, "crop_padding_seconds": 0.2}
    files = wav.audio(events, str(tmp_path))
    assert files.columns == ["audio_path", "bytes"]
    for name in ("handcrafted_stats", "lowfreq_all_plus_logmel"):
        got = {x["id"]: x["features"] for x in X.extract_from_files(events, files, name, cfg, per_task=7).collect()}
        waves = wav.waves(spark, str(tmp_path)).selectExpr("regexp_replace(audio_path, '^file:/+', '/') AS audio_path", "rate", "samples")
        want = {x["id"]: x["features"] for x in X.extract_from_files(events, waves, name, cfg).collect()}
        assert set(got) == set(want) == {i for i in range(60) if i % 4 < 2}
        assert all(np.allclose(got[i], want[i], rtol=1e-4, atol=1e-5) for i in want)


def test_only_wanted_files_are_opened(spark, tmp_path):
    """The time of the last access stays as it was for files without an event of the split."""
    for k in range(4):
        (tmp_path / f"{k}.wav").write_bytes(wav.encode(np.zeros(5000), 250))
        os.utime(tmp_path / f"{k}.wav", (1000, 2000))
    events = event_rows(spark, tmp_path, 4, 15).withColumns({"label": X.F.lit("a"), "domain": X.F.lit("d"), "is_test": X.F.lit(False)})
    assert api.feature_table(events.where("id % 4 = 1"), str(tmp_path), "waveform_stats", CFG).count() == 15
    opened = [os.stat(tmp_path / f"{k}.wav").st_atime != 1000 for k in range(4)]
    if not opened[1]:
        pytest.skip("this file system keeps no times of access")
    assert opened == [False, True, False, False]


def test_other_stores_read_the_named_files_only(spark, tmp_path, monkeypatch):
    for k in range(3):
        (tmp_path / f"{k}.wav").write_bytes(wav.encode(np.zeros(500), 250))
    monkeypatch.setattr(wav, "SEEKABLE", ())
    events = spark.createDataFrame([(1, f"file:{tmp_path}/1.wav"), (2, f"file:{tmp_path}/9.wav")], "id long, audio_path string")
    assert [r["audio_path"].rsplit("/", 1)[1] for r in wav.audio(events, str(tmp_path)).collect()] == ["1.wav"]
    assert wav.audio(events.where("id > 1"), str(tmp_path)).count() == 0
    with pytest.raises(ValueError, match="whole files"):
        wav.blocks(spark, "viewfs://store/x")
