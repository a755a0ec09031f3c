"""Islands of a stream of frames: runs of consecutive frames, closed as soon as the watermark rules out another frame.

A run is a session of event time whose gap lies between one frame and two, so frames may come in any order, also such as
join two runs. What is kept is one row for each open run, in Spark's state store; no frame is.

Defined results: those of ``temporal.islands`` for the same frames, if each comes once and no later than ``late`` behind
the latest frame of the stream; later ones are left out. Frames without a prediction, or with too little confidence, move
the watermark as others do. Frames without a time, or with null in place of prediction or confidence, are no part of a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrid.operators.temporal import DetectorConfig, detections_of
from callgrid.streaming.detections import to_table


def timed(frames: DataFrame, fps: float, origin: str | None = None) -> DataFrame:
    """The frames with ``ts``, the time at which each begins; ``origin`` names the column of a recording's first moment."""
    first = F.unix_micros(origin) if origin else F.lit(0)
    return frames.withColumn("ts", F.timestamp_micros(first + F.round(F.col("frame") * 1e6 / fps).cast("long")))


def streamed_islands(frames: DataFrame, config: DetectorConfig, late: str = "10 minutes") -> DataFrame:
    """Detections (audio_path, start, end, label, confidence) from frames (audio_path, frame, ts, pred, confidence)."""
    on = (F.col("pred") > 0) & (F.col("confidence") >= config.confidence_threshold)
    # One condition that names the time: Catalyst leaves it above the watermark, which silent frames have to move as well.
    heard = frames.withWatermark("ts", late).where(F.when(on, F.col("ts")).isNotNull())
    run = F.session_window("ts", f"{round(1.5e6 / config.fps)} microseconds")
    return detections_of(heard.groupBy("audio_path", run.alias("run")), config)


def drained(folder: str, schema, config: DetectorConfig, out: str, checkpoint: str, late: str = "10 minutes", files: int | None = None) -> DataFrame:
    """All runs closed by the frames that lie in a folder by now, ``files`` of them a batch. A later call with the same
    checkpoint goes on with the open runs; all folders must be shared. Tasks merge the frames they read into runs before
    these are shuffled; where the files hold whole recordings, a run is one row from then on."""
    spark = SparkSession.getActiveSession()
    merged = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    source = spark.readStream.schema(schema)
    source = source.option("maxFilesPerTrigger", files) if files else source
    found = streamed_islands(source.parquet(folder), config, late)
    before = spark.conf.get(merged, None)
    spark.conf.set(merged, "true")
    try:
        to_table(found, out, checkpoint).awaitTermination()
    finally:
        spark.conf.set(merged, before) if before is not None else spark.conf.unset(merged)
    return spark.read.schema(found.schema).parquet(out)
