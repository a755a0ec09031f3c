"""Images: event tensors as PNG bytes in a table, panels, exported files, a tensor cache, and the read side."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrid.functions import features as X
from callgrid.functions import kernels as K
from callgrid.runtime import by_value, slices
from callgrid.sources.sinks import png

by_value(__name__)

#: Version of the cached tensors: part of their keys.
TENSOR_VERSION = 1


def event_images(rows: DataFrame, cfg: dict, size: int = 224, id_column: str = "id") -> DataFrame:
    """(id, png): the three planes of each event's tensor as RGB; rows carry samples and rate."""
    fields = [c for c in rows.columns if c not in (id_column, "samples", "rate")]

    def run(batches):
        for b in slices(batches, 16):
            d = b.to_pydict()
            out = [png(np.moveaxis(X.event_tensor(X.prepared({f: d[f][i] for f in fields}, d["samples"][i], d["rate"][i], cfg), cfg, size), 0, 2))
                for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(id_column), pa.array(out, pa.binary())], names=[id_column, "png"])

    return rows.mapInArrow(run, f"{id_column} {dict(rows.dtypes)[id_column]}, png binary")


def crop_panels(events: DataFrame, audio: DataFrame, cfg: dict, size: int = 224, id_column: str = "id") -> DataFrame:
    """(id, png, extents): the whole event beside its literal box, and where the box lies: seconds from the file's start,
    hertz, rows and frames of the crop."""

    def make(e):
        image = X.event_tensor(e, cfg, size)[0]
        values, f, t = X.boxed(e, cfg)
        crop = K.resize(values[::-1], size, size)
        panel = np.concatenate([image, np.ones((size, max(2, size // 32))), crop], 1)
        start, end = e.span
        return png(panel), start, end, float(f[0]), float(f[-1]), len(f), len(t)

    names = ("start_seconds", "end_seconds", "lowest_hz", "highest_hz")
    columns = [("png", "binary", pa.binary()), *((n, "double", pa.float64()) for n in names), ("rows", "int", pa.int32()), ("frames", "int", pa.int32())]
    return X.of_events(events, audio, cfg, make, columns, id_column)


def cached_tensors(events: DataFrame, audio: DataFrame, files: DataFrame, cfg: dict, root: str, size: int = 64, id_column: str = "id") -> DataFrame:
    """(id, split, label, key, tensor) of all events, from a cache by split and label; missing ones are made and added.

    The key is a hash of the version, the file's path, length and time of change (``files``: audio_path, bytes, modified),
    the event's box and the audio settings, so a changed file or setting makes new tensors.
    """
    from callgrid.sources.sinks import exists

    spark, box = events.sparkSession, ("clip_start_seconds", "clip_end_seconds", "low_frequency", "high_frequency")
    about = json.dumps({"version": TENSOR_VERSION, "size": size, "audio": cfg}, sort_keys=True)
    key = F.sha1(F.to_json(F.struct(F.lit(about).alias("about"), "audio_path", "bytes", "modified", *box)))
    keyed = events.join(files.select("audio_path", "bytes", F.col("modified").cast("string").alias("modified")), "audio_path").withColumn("key",
        key).drop("bytes", "modified")
    missing = keyed
    if exists(spark, root):
        missing = keyed.join(spark.read.parquet(root).select("key").distinct(), "key", "left_anti")

    def make(e):
        return e.row["key"], X.event_tensor(e, cfg, size).ravel().tolist()

    made = X.of_events(missing, audio, cfg, make, [("key", "string", pa.string()), ("tensor", "array<float>", pa.list_(pa.float32()))], id_column)
    made.join(missing.select(id_column, "split", "label"), id_column).drop(id_column).dropDuplicates(["key"]).write.mode("append").partitionBy("split",
        "label").parquet(root)
    return keyed.select(id_column, "split", "label", "key").join(spark.read.parquet(root).select("key", "tensor"), "key")


def export(images: DataFrame, folder: str, id_column: str = "id") -> DataFrame:
    """(id, image_path): one file per row under a shared folder, written by the tasks through pyarrow.fs."""

    def run(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for b in slices(batches, 64):
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with system.open_output_stream(f"{root}/{key}.png") as out:  # the same bytes from every attempt
                    out.write(data)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f"{folder}/{k}.png" for k in b.column(0).to_pylist()])], names=[id_column, "image_path"])

    return images.select(id_column, "png").mapInArrow(run, f"{id_column} {dict(images.dtypes)[id_column]}, image_path string")


def error_images(predictions: DataFrame, images: DataFrame, folder: str, limit: int = 20) -> DataFrame:
    """(id, true and predicted label, confidence, image_path) of the most confident errors: a report of ``limit`` rows."""
    from callgrid.operators.metrics import errors

    worst = errors(predictions).orderBy(F.desc("pred_confidence"), "id").limit(limit)
    return worst.select("id", "y_true_label", "y_pred_label", "pred_confidence").join(export(images.join(worst.select("id"), "id"), folder), "id")


def heatmap(dense: DataFrame, classes, cell: int = 24) -> bytes:
    """The normalised confusion matrix as a grey image, a square per cell, true labels downwards; dark is much."""
    from callgrid.operators.metrics import normalised_confusion

    at = {c: i for i, c in enumerate(classes)}
    a = np.zeros((len(classes), len(classes)))
    for r in normalised_confusion(dense).collect():  # classes squared
        a[at[r["true"]], at[r["pred"]]] = r["share"]
    return png(1 - np.kron(a, np.ones((cell, cell))))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(image_path, height, width, channels, data) of image files."""
    i = spark.read.format("image").option("dropInvalid", True).load(path)
    return i.select(F.col("image.origin").alias("image_path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def tensors(spark: SparkSession, path: str, size: int = 224) -> DataFrame:
    """(image_path, tensor): RGB images as 3 x size x size numbers in 0..1, channels first, resized bilinearly."""

    def run(batches):
        for b in slices(batches, 16):
            out = []
            for h, w, n, data in zip(*(b.column(c).to_pylist() for c in ("height", "width", "channels", "data")), strict=True):
                a = np.frombuffer(data, np.uint8).reshape(h, w, n)[:, :, ::-1] if n == 3 else np.repeat(np.frombuffer(data, np.uint8).reshape(h, w, n)[:,
                    :, :1], 3, 2)  # Spark keeps BGR
                out.append(np.stack([K.resize(a[:, :, c] / 255.0, size, size) for c in range(3)]).astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([b.column("image_path"), *X._vectors(None, out)[1:]], names=["image_path", "tensor"])

    return read(spark, path).mapInArrow(run, "image_path string, tensor array<float>")
