"""Temporal detection: frames, islands, boxes, overlap matching. Everything is per file and needs no loop over files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callgrid.functions.scalars import temporal_iou


@dataclass(frozen=True)
class DetectorConfig:
    fps: float = 4.0
    min_event_seconds: float = 0.5
    confidence_threshold: float = 0.5
    multiclass: bool = False
    classes: tuple[str, ...] = ()


def frame_labels(events: DataFrame, duration: str, fps: float, order: str) -> DataFrame:
    """(audio_path, frame, label) of all marked frames; where events overlap the one last in ``order`` wins.

    An event marks floor(start x fps) up to ceil(end x fps), inside the file; a negative start counts as 0.

    Events are brought together by file before they are taken apart, so frames, which are many more, need no shuffle, here
    or where they are grouped by file later. The number of partitions is fixed: by the bytes of events alone they would be
    merged. Labels that are numbers are hashed, where texts are sorted.
    """
    n = F.ceil(F.col(duration) * fps)
    first, end = F.greatest(F.lit(0), F.floor(F.col("start") * fps)), F.least(F.ceil(F.col("end") * fps), n)
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_file = events.where(end > first).select("audio_path", "label", F.col(order).alias("__o"), first.alias("__a"), (end - 1).alias("__z")).repartition(
        parts, "audio_path")
    marked = by_file.select("audio_path", "label", "__o", F.explode(F.sequence("__a", "__z")).alias("frame"))
    return marked.groupBy("audio_path", "frame").agg(F.max_by("label", "__o").alias("label"))


def islands(frames: DataFrame, config: DetectorConfig) -> DataFrame:
    """Detections (audio_path, start, end, label, confidence) from frames (audio_path, frame, pred, confidence).

    Runs of consecutive frames with a prediction above 0 and enough confidence; too short runs go. The label is the
    commonest class (ties: the lowest index), the confidence the mean.
    """
    on = frames.where((F.col("pred") > 0) & (F.col("confidence") >= config.confidence_threshold))
    file = F.xxhash64("audio_path")  # sorts faster than paths, which begin alike
    run = F.col("frame") - F.row_number().over(W.partitionBy("__file", "audio_path").orderBy("frame"))
    return detections_of(on.withColumn("__file", file).withColumn("run", run).groupBy("audio_path", "run"), config)


def detections_of(runs, config: DetectorConfig) -> DataFrame:
    """The detections of kept frames that are grouped by file and run. A count for each class stands for the commonest one;
    predictions beyond the declared classes are counted together, and their label is null."""
    of = [F.count_if(F.col("pred") == i) for i in range(1, len(config.classes) + 1)] + [F.count_if(F.col("pred") > len(config.classes))]
    counts = [c.alias(f"__{i}") for i, c in enumerate(of)] if config.multiclass else []
    runs = runs.agg(F.min("frame").alias("first"), F.max("frame").alias("last"), *counts, F.avg("confidence").alias("confidence"))
    long = runs.where((F.col("last") - F.col("first") + 1) / config.fps >= config.min_event_seconds)
    label = F.lit("event")
    if config.multiclass:
        n = F.array(*[F.col(f"__{i}") for i in range(len(of))])
        label = F.get(F.array(*[F.lit(c) for c in config.classes], F.lit(None)), (F.array_position(n, F.array_max(n)) - 1).cast("int"))
    return long.select("audio_path", (F.col("first") / config.fps).alias("start"), ((F.col("last") + 1) / config.fps).alias("end"), label.alias("label"),
        "confidence")


def frame_predictions(frames: DataFrame, label_index, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """Stand-in predictions for marked frames: the class index, dropped for a hash-chosen share of frames."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "audio_path", F.col("frame").cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    return frames.withColumns({"pred": F.when(u < noise, 0).otherwise(label_index), "confidence": F.when(u < 2 * noise, 0.6).otherwise(0.9)})


def overlaps(detections: DataFrame, truths: DataFrame) -> DataFrame:
    """(audio_path, pred_id, gt_id, iou) of all pairs that overlap: an equi-join on file and time bucket.

    Both sides are cut at whole buckets of ``width`` seconds, so a file with very many events is spread over its
    buckets; a pair counts in the bucket where its overlap begins.
    """
    width = 300.0
    cut = lambda d, p: d.where("end > start").select("audio_path", F.col(f"{p}_id"), F.col("start").alias(f"{p}0"), F.col("end").alias(f"{p}1"),
        F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("bucket"))
    a, b = cut(detections, "pred"), cut(truths, "gt")
    both = a.join(b, ["audio_path", "bucket"]).where("pred0 < gt1 AND gt0 < pred1")
    own = both.where(F.floor(F.greatest("pred0", "gt0") / width) == F.col("bucket"))
    return own.select("audio_path", "pred_id", "gt_id", temporal_iou(F.col("pred0"), F.col("pred1"), F.col("gt0"), F.col("gt1")).alias("iou"))


def matches(detections: DataFrame, truths: DataFrame, thresholds) -> DataFrame:
    """(audio_path, threshold, pred_id, gt_id, iou) of true positives.

    Each detection tries only its best truth (ties: the first), and a truth goes to the first detection that passes.
    """
    best = overlaps(detections, truths).withColumn("iou", F.round("iou", 9))
    best = best.withColumn("n", F.row_number().over(W.partitionBy("audio_path", "pred_id").orderBy(F.desc("iou"), "gt_id"))).where("n = 1").drop("n")
    tried = best.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).where("iou >= threshold")
    first = F.row_number().over(W.partitionBy("audio_path", "threshold", "gt_id").orderBy("pred_id"))
    return tried.withColumn("n", first).where("n = 1").select("audio_path", "threshold", "pred_id", "gt_id", "iou")


def file_summary(detections: DataFrame, truths: DataFrame, thresholds) -> DataFrame:
    """(audio_path, threshold, gt, detected, tp, fp, fn, mean_iou) for every file of either side."""
    d, t = detections.groupBy("audio_path").agg(F.count("*").alias("detected")), truths.groupBy("audio_path").agg(F.count("*").alias("gt"))
    files = t.join(d, "audio_path", "full").select("audio_path", F.coalesce("gt", F.lit(0)).alias("gt"), F.coalesce("detected",
        F.lit(0)).alias("detected"), F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold"))
    tp = matches(detections, truths, thresholds).groupBy("audio_path", "threshold").agg(F.count("*").alias("tp"), F.avg("iou").alias("mean_iou"))
    out = files.join(tp, ["audio_path", "threshold"], "left")
    n = F.coalesce("tp", F.lit(0))
    iou = F.when((F.col("gt") == 0) & (F.col("detected") == 0), 1.0).otherwise(F.coalesce("mean_iou", F.lit(0.0)))
    return out.select("audio_path", "threshold", "gt", "detected", n.alias("tp"), (F.col("detected") - n).alias("fp"), (F.col("gt") - n).alias("fn"),
        iou.alias("mean_iou"))


def totals(summary: DataFrame) -> DataFrame:
    """Per threshold: counts over all files, precision, recall, F1, and the mean of the files' mean overlaps."""
    s = summary.groupBy("threshold").agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.avg("mean_iou").alias("mean_iou"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    s = s.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return s.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def run_summary(detections: DataFrame, truths: DataFrame) -> DataFrame:
    """One row: files of either side, truths, detections."""
    sides = truths.select("audio_path", F.lit(1).alias("t"), F.lit(0).alias("d")).unionAll(detections.select("audio_path", F.lit(0), F.lit(1)))
    return sides.agg(F.count_distinct("audio_path").alias("files"), F.sum("t").alias("truths"), F.sum("d").alias("detections"))


REPORT_THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def detect(events: DataFrame, duration: str, order: str, config: DetectorConfig, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """Frames from annotations, stand-in predictions on them, islands."""
    from callgrid.functions.labels import code

    index = F.coalesce(code(F.col("label"), config.classes) + 1, F.lit(0)) if config.multiclass else F.lit(1)
    frames = frame_labels(events.withColumn("label", index), duration, config.fps, order)
    return islands(frame_predictions(frames, F.col("label"), noise, seed), config)
