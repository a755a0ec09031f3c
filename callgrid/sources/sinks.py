"""Sinks: Spark writers for tables of any size, driver-side writers for reports of fixed size."""

from __future__ import annotations

import hashlib
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrid.runtime import remove
from callgrid.sources.config import stable_hash


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def report(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A report table as one CSV file on the driver's disk; larger tables belong in ``write_csv``."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write the table with Spark")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    rows.to_csv(path, index=False)


def write_json(value, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, default=lambda x: x.item() if hasattr(x, "item") else str(x))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown: floats with four digits, missing cells empty. Larger tables are an error."""
    cell = lambda v: "" if v is None or v != v else f"{v:.4f}" if isinstance(v, float) else str(v)
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write the table with Spark")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def export_matrix(df: DataFrame, path: str, names: list[str], metadata: dict) -> None:
    """A feature matrix as Parquet (id, label, features) with its names and metadata beside it."""
    df.write.mode("overwrite").parquet(f"{path}/matrix")
    df.sparkSession.createDataFrame([(json.dumps(names), json.dumps(metadata, sort_keys=True))],
        "names string, metadata string").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def manifest_signature(rows: DataFrame) -> dict:
    """What a cache of features depends on in a manifest: its columns, and an order-free hash and count of its rows."""
    names = sorted(rows.columns)
    r = rows.select(F.xxhash64(*names).alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("h")).first()
    return {"columns": names, "rows": r["n"], "hash": r["h"]}


def cached(spark: SparkSession, root: str, key, make) -> DataFrame:
    """A table kept under the hash of what it depends on; made once."""
    path = f"{root.rstrip('/')}/{stable_hash(key)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cache_summary(spark: SparkSession, root: str) -> DataFrame:
    """(files, bytes) of a cache."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def clear_cache(spark: SparkSession, root: str, except_current: bool = False) -> None:
    if except_current:
        raise ValueError("clearing all but the current entry is not supported: entries don't know their users")
    remove(spark, root)


def run_table(spark: SparkSession, runs_root: str, score: str = "macro_f1") -> DataFrame:
    """A row for each run with a metrics file: (run, score, has_predictions), best first, runs without a score last."""
    runs = spark.read.option("multiLine", True).schema(f"{score} double").json(f"{runs_root}/*/best_metrics.json")
    run = lambda c: F.regexp_extract(c, "(.*)/[^/]*$", 1)
    runs = runs.select(run(F.col("_metadata.file_path")).alias("run"), score)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*predictions*").load(runs_root)
    having = files.select(run(F.col("_metadata.file_path")).alias("run")).distinct().withColumn("has_predictions", F.lit(True))
    return runs.join(having, "run", "left").na.fill(False, ["has_predictions"]).orderBy(F.desc_nulls_last(score), "run")


def latest_run(spark: SparkSession, runs_root: str, score: str = "macro_f1") -> str | None:
    """The run directory with the best score among those with a metrics file and predictions."""
    return run_table(spark, runs_root, score).where("has_predictions").agg(F.max_by("run", F.struct(F.coalesce(F.col(score), F.lit(-1.0)), "run"))).first()[0]


def last_report(spark: SparkSession, root: str, name: str) -> str:
    """The last report of a name in the run directories, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    found = files.agg(F.max("path")).first()[0]
    if found is None:
        raise FileNotFoundError(f"no {name} under {root}")
    return found


def readme_score(text: F.Column):
    """The last ``Macro-F1: x`` in a text."""
    return F.element_at(F.regexp_extract_all(text, F.lit(r"Macro-F1:\s*([0-9.]+)"), F.lit(1)), -1).cast("double")


def provenance(counts: dict, files: list[str], commands: list[str]) -> dict:
    """Record of a run: time, SHA-256 of the named local files, row counts, commands."""
    def sha256(path):
        h = hashlib.sha256()
        with open(path, "rb") as f:
            while block := f.read(1 << 20):
                h.update(block)
        return h.hexdigest()

    return {"created_utc": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "files": {p: sha256(p) for p in files}, "rows": counts, "commands": commands}


def png(image) -> bytes:
    """8-bit grey or RGB PNG of an array in 0..1 (height x width, or height x width x 3)."""
    import struct
    import zlib

    import numpy as np

    a = np.clip(np.asarray(image) * 255, 0, 255).round().astype(np.uint8)
    h, w = a.shape[:2]
    raw = b"".join(b"\0" + a[i].tobytes() for i in range(h))
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT",
        zlib.compress(raw)) + chunk(b"IEND", b"")
