"""Annotation tables: CSV files of one site and year each, with their header checked before their rows are read."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callgrid.operators import ingest
from callgrid.runtime import stage
from callgrid.schema import MANIFEST, REQUIRED
from callgrid.sources import wav


def headers(spark: SparkSession, data_root: str, split: str) -> DataFrame:
    """(split, source, columns) from the first line of every file."""
    lines = spark.read.text(f"{data_root}/{split}/annotations/*.csv").select("value", F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("at"))
    first = lines.where("at = 0").groupBy("source").agg(F.first("value").alias("value"))
    return first.select(F.lit(split).alias("split"), "source", F.transform(F.split("value", ","), lambda c: F.trim(F.btrim(c, F.lit('"﻿')))).alias("columns"))


def annotation_rows(spark: SparkSession, data_root: str, splits=("train", "validation")) -> tuple[DataFrame, DataFrame]:
    """(rows of the files with all required columns, issues of the others). Row numbers count from 0 in each file.

    Files are grouped by their header: one scan for each kind of header, however many files there are. A file's rows are
    numbered by its blocks and their order in a block.
    """
    heads = reduce(DataFrame.unionAll, [headers(spark, data_root, s) for s in splits])
    heads = stage(heads, "annotation-headers")
    bad = ingest.missing_columns(heads, REQUIRED)
    good = heads.join(bad.select("source"), "source", "left_anti")
    order = F.array_position(F.array(*[F.lit(s) for s in splits]), F.col("split"))
    ranks = stage(good.select("split", "source", (F.row_number().over(W.orderBy(order, "source")) - 1).cast("int").alias("file_rank")), "annotation-files")
    kinds: dict = {}
    for r in good.select("source", "columns").collect():  # a row per file: the scans' lists of paths
        kinds.setdefault(tuple(r["columns"]), []).append(unquote(r["source"]))
    scans = []
    for columns, paths in sorted(kinds.items()):
        schema = ", ".join(f"`{c}` {'double' if c in ('low_frequency', 'high_frequency') else 'string'}" for c in columns)
        raw = spark.read.schema(schema).option("header", True).csv(sorted(paths))
        place = [F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("__block"),
            F.monotonically_increasing_id().alias("__at")]
        scans.append(raw.select(*REQUIRED, *place))
    if not scans:
        fields = [f"{c} {'double' if c in ('low_frequency', 'high_frequency') else 'string'}" for c in REQUIRED]
        scans = [spark.createDataFrame([], ", ".join([*fields, "source string", "__block long", "__at long"]))]
    rows = reduce(DataFrame.unionByName, scans).join(ranks, "source")
    nth = F.row_number().over(W.partitionBy("source").orderBy("__block", "__at"))
    rows = rows.withColumn("source_row", (nth - 1).cast("long")).withColumnRenamed("source", "source_annotation").drop("__block", "__at")
    return rows, bad


def located(rows: DataFrame, data_root: str, durations: DataFrame) -> DataFrame:
    """Rows with audio_path, audio_exists and audio_duration_seconds; the file table has one row per WAV file."""
    path = F.concat_ws("/", F.lit(data_root.rstrip("/")), "split", F.lit("audio"), "dataset", "filename")
    files = durations.select(F.regexp_replace("audio_path", "^file:/+", "/").alias("audio_path"), F.col("duration").alias("audio_duration_seconds"),
        F.lit(True).alias("__there"))
    out = rows.withColumn("audio_path", F.regexp_replace(path, "^file:/+", "/")).join(files, "audio_path", "left")
    return ingest.with_offsets(out.withColumn("audio_exists", F.coalesce("__there", F.lit(False))).drop("__there"))


def manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """A manifest written as CSV, with its types: numbers, rows and the flag of valid events."""
    kinds = {"source_row": "long", "valid_event": "boolean"} | {c: "double" for c in MANIFEST if c.endswith(("_frequency", "_seconds"))}
    first = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0).first()
    columns = [c.strip().strip('"') for c in first[0].split(",")] if first else list(MANIFEST)
    return spark.read.schema(", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in columns)).option("header", True).csv(path)


def build_manifest(spark: SparkSession, data_root: str, splits=("train", "validation"), min_valid_seconds: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(manifest, issues) of an annotated data root."""
    rows, headless = annotation_rows(spark, data_root, splits)
    durations = wav.durations(spark, data_root)
    checked = ingest.checked(located(rows, data_root, durations), min_valid_seconds=min_valid_seconds)
    return ingest.manifest(checked), ingest.issues(checked).unionByName(headless, allowMissingColumns=True)
