"""Islands of a stream: frames in any order within the watermark, late ones, open runs, silent frames."""

import numpy as np

from callgrid.operators import temporal
from callgrid.streaming import islands

CONFIG = temporal.DetectorConfig(4.0, 0.5, 0.5, True, ("a", "b"))
SCHEMA = "audio_path string, frame long, pred int, confidence double"


def frames(spark, n=400, seed=0):
    r = np.random.default_rng(seed)
    rows = [(f, i, int(p), float(c)) for f in ("x", "y", None) for i, p, c in zip(range(n), r.integers(0, 3, n), r.choice([0.4, 0.6, 0.8], n), strict=True)]
    return islands.timed(spark.createDataFrame([rows[i] for i in r.permutation(len(rows))], SCHEMA), CONFIG.fps)


def rows(df):
    return sorted((str(r["audio_path"]), r["start"], r["end"], r["label"], round(r["confidence"], 9)) for r in df.collect())


def arrive(df, tmp_path, parts=1):
    df.repartition(parts).write.mode("append").parquet(str(tmp_path / "in"))


def drain(tmp_path, schema, late, files=None):
    return islands.drained(str(tmp_path / "in"), schema, CONFIG, str(tmp_path / "out"), str(tmp_path / "checkpoint"), late, files)


def silence(spark, second):
    return islands.timed(spark.createDataFrame([("z", int(second * CONFIG.fps), 0, 0.9)], SCHEMA), CONFIG.fps)


def test_any_order_equals_the_table(spark, tmp_path):
    df = frames(spark)
    arrive(df, tmp_path, 5)
    open_runs = rows(drain(tmp_path, df.schema, "2 minutes", 1))  # 100 s of frames: nothing is late, nothing closed
    assert open_runs == []
    arrive(silence(spark, 400), tmp_path)  # no detection, yet it moves the watermark
    want = rows(temporal.islands(df.drop("ts"), CONFIG))
    assert len(want) > 50 and rows(drain(tmp_path, df.schema, "2 minutes")) == want


def test_late_frames_are_left_out_and_others_join_runs(spark, tmp_path):
    of = lambda *at: islands.timed(spark.createDataFrame([("x", i, 1, 0.8) for i in at], SCHEMA), CONFIG.fps)
    first = of(0, 1, 3, 4, 40, 41)
    arrive(first, tmp_path)
    drain(tmp_path, first.schema, "20 seconds")
    arrive(of(2), tmp_path)  # joins 0-1 and 3-4
    drain(tmp_path, first.schema, "20 seconds")
    arrive(silence(spark, 25), tmp_path)  # closes 0-4
    drain(tmp_path, first.schema, "20 seconds")
    arrive(of(5, 42), tmp_path)  # 5 is late, 42 isn't
    drain(tmp_path, first.schema, "20 seconds")
    arrive(silence(spark, 90), tmp_path)
    got = rows(drain(tmp_path, first.schema, "20 seconds"))
    assert [(r[1], r[2]) for r in got] == [(0.0, 1.25), (10.0, 10.75)]


def test_nulls_and_an_empty_table(spark, tmp_path):
    df = islands.timed(spark.createDataFrame([("x", None, 1, 0.8), ("x", 1, None, 0.8), ("x", 2, 1, None)], SCHEMA), CONFIG.fps)
    assert rows(islands.streamed_islands(df, CONFIG)) == rows(islands.streamed_islands(df.limit(0), CONFIG)) == []


def test_tasks_merge_runs_before_the_shuffle(spark, tmp_path, monkeypatch):
    """Before, each frame was shuffled as a run of its own. The session's setting is back afterwards."""
    name, seen, start = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", [], islands.to_table
    before = spark.conf.get(name, None)
    monkeypatch.setattr(islands, "to_table", lambda *a: seen.append(spark.conf.get(name, None)) or start(*a))
    df = frames(spark, 8)
    arrive(df, tmp_path)
    drain(tmp_path, df.schema, "2 minutes")
    assert seen == ["true"] and spark.conf.get(name, None) == before
