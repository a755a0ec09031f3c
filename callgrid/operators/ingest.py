"""Manifest building: one CASE cascade over located annotations, split into manifest and issues.

Input: a row per annotation with the columns of ``schema.ANNOTATION`` (unparsed), split, audio_path, audio_exists,
audio_duration_seconds, start_seconds, end_seconds (null where a time can't be read), source_annotation, source_row and
file_rank. The order of the checks is part of the contract: an event's first occurrence owns its key even if a later
check rejects it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from callgrid.functions import labels as L
from callgrid.functions import scalars as S
from callgrid.schema import ISSUES, MANIFEST

EVENT_KEY = ("split", "dataset", "filename", "label", "start_datetime", "end_datetime")


def with_offsets(rows: DataFrame) -> DataFrame:
    """start_seconds and end_seconds from the file name and the annotation's times."""
    start = S.audio_start(F.col("filename"))
    return rows.withColumns({f"{x}_seconds": S.seconds_between(start, S.annotation_time(F.col(f"{x}_datetime"))) for x in ("start", "end")})


def checked(rows: DataFrame, aliases: dict = L.ALIASES, display: dict = L.DISPLAY, min_valid_seconds: float = 0.5) -> DataFrame:
    """All rows with label, clip columns, and issue: the first check that fails, null for a kept event."""
    out = rows.withColumn("label_raw", F.trim("annotation")).withColumn("label", L.normalised(F.col("annotation"), aliases))
    eligible = F.col("label").isNotNull() & F.col("audio_exists")
    first = W.partitionBy(*EVENT_KEY, eligible).orderBy("file_rank", "source_row")
    duration = F.col("end_seconds") - F.col("start_seconds")
    clip0, clip1 = F.greatest(F.lit(0.0), "start_seconds"), F.least("end_seconds", "audio_duration_seconds")
    out = out.withColumns({"__repeat": eligible & (F.row_number().over(first) > 1), "duration_seconds": duration, "clip_start_seconds": clip0,
        "clip_end_seconds": clip1, "real_duration_seconds": clip1 - clip0})
    issue = (
        F.when(F.col("label").isNull(), F.concat(F.lit("unknown_label_alias:"), "label_raw"))
        .when(~F.col("audio_exists"), "missing_audio")
        .when(F.col("__repeat"), "duplicate_event")
        .when(F.col("audio_duration_seconds").isNull(), "audio_duration_error")
        .when(F.col("start_seconds").isNull() | F.col("end_seconds").isNull(), "datetime_parse_error")
        .when(F.col("duration_seconds") <= 0, "non_positive_duration")
        .when(F.col("start_seconds") >= F.col("audio_duration_seconds"), "start_after_audio_end")
        .when(F.col("real_duration_seconds") < min_valid_seconds, "too_little_audio")
    )
    status = F.when(F.col("end_seconds") <= F.col("audio_duration_seconds"), "ok").otherwise("clipped_end")
    return out.withColumns({"issue": issue, "label_display": L.mapped(F.col("label"), display), "quality_status": status,
        "valid_event": F.lit(True)}).drop("__repeat")


def manifest(all_rows: DataFrame) -> DataFrame:
    return all_rows.where("issue IS NULL").select(*MANIFEST)


def issues(all_rows: DataFrame) -> DataFrame:
    """Rejected rows in one fixed schema; times only where the check had them."""
    timed = F.col("issue").isin("start_after_audio_end", "too_little_audio")
    rows = all_rows.where("issue IS NOT NULL").withColumns({"source": F.col("source_annotation"), "row": F.col("source_row")})
    for c in ("start_seconds", "end_seconds", "audio_duration_seconds"):
        rows = rows.withColumn(c, F.when(timed, F.col(c)))
    rows = rows.withColumn("real_duration_seconds", F.when(F.col("issue") == "too_little_audio", F.col("real_duration_seconds")))
    return rows.select(*ISSUES)


def missing_columns(header: DataFrame, required) -> DataFrame:
    """(split, source, issue) for files whose header (split, source, columns array) lacks a required column."""
    lacks = F.array_sort(F.array_except(F.array(*[F.lit(c) for c in required]), "columns"))
    return header.where(F.size(lacks) > 0).select("split", "source", F.concat(F.lit("missing_columns:"), F.array_join(lacks, ",")).alias("issue"))


def valid_rows(rows: DataFrame, splits=None) -> DataFrame:
    """Rows whose valid_event reads as true (it may be text), of the wanted splits."""
    if "valid_event" in rows.columns:
        rows = rows.where(F.lower(F.col("valid_event").cast("string")) == "true")
    return rows.where(F.col("split").isin(*splits)) if splits else rows


def split_of_path(path, default: str = "validation"):
    return F.when(path.contains("/train/"), "train").when(path.contains("/validation/"), "validation").otherwise(default)


def split_role(split, official: str = "validation"):
    return F.when(split == official, "official_held_out_test").when(split == "inner_validation", "inner_validation").when(split == "train",
        "official_train").otherwise("custom")


def metadata(rows: DataFrame, columns, optional=()) -> DataFrame:
    """The columns that exist, wanted ones first."""
    return rows.select(*[c for c in columns if c in rows.columns], *[c for c in optional if c in rows.columns and c not in columns])
