"""Frames need no shuffle of their own, and their labels no sort; a run's class is counted."""

from callgrid.operators import temporal

CONFIG = temporal.DetectorConfig(1.0, 1.0, 0.5, True, ("a", "b"))


def test_events_are_shuffled_not_frames(spark, capsys):
    """Before, frames were shuffled to find labels and again to find runs, and labels and classes were sorted."""
    events = spark.createDataFrame([("x", i, i * 5.0, i * 5.0 + 8, "ab"[i % 2]) for i in range(40)], "audio_path string, o long, start double, end double, label string")
    found = temporal.detect(events.selectExpr("*", "300D AS length"), "length", "o", CONFIG, noise=0.0)
    assert [(r["start"], r["end"]) for r in found.collect()] == [(0.0, 203.0)]
    found.explain()
    plan = capsys.readouterr().out.split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_commonest_class(spark):
    rows = [("x", 0, 2), ("x", 1, 1), ("x", 2, 2), ("y", 0, 2), ("y", 1, 1), ("z", 0, 3), ("z", 1, 3), ("z", 2, 1)]
    frames = spark.createDataFrame([(*r, 0.8) for r in rows], "audio_path string, frame long, pred int, confidence double")
    got = {r["audio_path"]: r["label"] for r in temporal.islands(frames, CONFIG).collect()}
    assert got == {"x": "b", "y": "a", "z": None}
