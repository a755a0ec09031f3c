"""Stand-ins for annotated audio over the driver's tables: each is a plain projection, so it is the same in any SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALIASES = {k: k for k in ("view", "click", "signup", "purchase")}
DISPLAY = {"view": "View", "click": "Click", "signup": "Sign-up", "purchase": "Purchase"}
FAMILIES = {"view": "browse", "click": "browse", "signup": "convert", "purchase": "convert"}
CLASSES = tuple(ALIASES)
VECTOR_CLASSES = tuple(f"c{i}" for i in range(10))
VECTOR_FAMILIES = {f"c{i}": "low" if i < 4 else "middle" if i < 7 else "high" for i in range(10)}
DAY_END = 82800.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located annotations from ``events``: a user and day is an audio file, an event a box in it."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    u, day = F.col("user_id"), F.date_format("ts", "yyyy-MM-dd")
    raw = F.when(F.col("event_id") % 4 == 0, F.col("event_type")).when(F.col("event_id") % 4 == 1, F.upper("event_type")).when(F.col("event_id") % 4 == 2,
        F.concat(F.substring("event_type", 1, 1), F.lit("-"), F.expr("substring(event_type, 2)"))).otherwise(F.concat(F.lit(" "), F.col("event_type"),
            F.lit("_")))
    start = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double")
    split = F.when(u % 11 >= 8, "validation").otherwise("train")
    dataset = F.concat(F.lit("site_"), (u % 11).cast("string"))
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        split.alias("split"), dataset.alias("dataset"), F.concat_ws("_", u.cast("string"), day).alias("filename"),
        F.concat_ws("/", F.lit("audio"), split, dataset, F.concat_ws("_", u.cast("string"), day)).alias("audio_path"), raw.alias("annotation"),
            F.lit("test").alias("annotator"),
        k.alias("low_frequency"), (k + 20).alias("high_frequency"), F.floor(start / 3600).cast("string").alias("start_datetime"),
            F.lit("").alias("end_datetime"),
        start.alias("start_seconds"), (start + F.col("value")).alias("end_seconds"), (u % 13 != 12).alias("audio_exists"),
            F.lit(DAY_END).alias("audio_duration_seconds"),
        F.lit("events").alias("source_annotation"), F.col("event_id").alias("source_row"), F.lit(0).alias("file_rank"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, features, domain, is_test) from ``embeddings``."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("id"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"),
        F.col("embedding").cast("array<double>").alias("features"), F.concat(F.lit("d"), (F.col("vec_id") % 7).cast("string")).alias("domain"),
            (F.col("vec_id") % 5 == 0).alias("is_test"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic prediction table over ``embeddings``: every third label is moved, confidences repeat."""
    v = table(spark, sf_dir, "embeddings")
    i, wrong = F.col("vec_id"), F.col("vec_id") % 3 == 0
    moved = F.when(wrong, (F.col("label") + i % 4) % 10).otherwise(F.col("label"))
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    confidence = 0.5 + (i % 50) / 100
    return v.select(
        i.alias("id"), F.concat(F.lit("d"), (i % 7).cast("string")).alias("dataset"), name(F.col("label")).alias("y_true_label"),
            name(moved).alias("y_pred_label"),
        confidence.alias("pred_confidence"), F.when(moved == F.col("label"), confidence).otherwise(1 - confidence).alias("true_probability"),
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground-truth intervals (audio_path, gt_id, start, end, label) of kept length, from ``events``."""
    a = annotations(spark, sf_dir)
    ok = a.where("end_seconds > start_seconds AND start_seconds < audio_duration_seconds")
    return ok.select("audio_path", F.col("source_row").alias("gt_id"), F.col("start_seconds").alias("start"), F.least("end_seconds",
        "audio_duration_seconds").alias("end"), F.element_at(F.split(F.lower(F.regexp_replace(F.trim("annotation"), "[-_ ]", "")), ":"), 1).alias("label"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections (audio_path, pred_id, start, end, label, confidence): truths moved by an id-made offset, some left out."""
    g = intervals(spark, sf_dir)
    shift = (F.col("gt_id") % 7 - 3) * 0.1 * (F.col("end") - F.col("start"))
    return g.where("gt_id % 6 <> 0").select("audio_path", F.col("gt_id").alias("pred_id"), (F.col("start") + shift).alias("start"), (F.col("end")
        + shift).alias("end"), "label", (0.5 + (F.col("gt_id") % 40) / 100).alias("confidence"))


#: The same stand-ins as DuckDB views, for the oracles.
ANNOTATIONS_SQL = f"""annotations AS (
 
  SELECT CASE WHEN user_id % 11 >= 8 THEN 'validation' ELSE 'train' END AS split, 'site_' || (user_id % 11) AS dataset, user_id || '_' || strftime(ts, '%Y-%m-%d') AS filename,
    'audio/' || CASE WHEN user_id % 11 >= 8 THEN 'validation' ELSE 'train' END || '/site_' || (user_id % 11) || '/' || user_id || '_' || strftime(ts, '%Y-%m-%d') AS audio_path,
    CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN upper(event_type) WHEN 2 THEN event_type[1] || '-' || event_type[2:] ELSE ' ' || event_type || '_' END AS annotation,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS low_frequency, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 20 AS high_frequency,
    CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS DOUBLE) AS start_seconds, CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS DOUBLE) + value AS end_seconds,
    user_id % 13 <> 12 AS audio_exists, {DAY_END} AS audio_duration_seconds, event_id AS source_row FROM events
)"""
CHECKED_SQL = f"""{ANNOTATIONS_SQL}, keyed AS (
  SELECT *, replace(replace(replace(lower(trim(annotation)), '-', ''), '_', ''), ' ', '') AS k, trim(annotation) AS label_raw FROM annotations
), labelled AS (SELECT *, CASE WHEN k IN ('view', 'click', 'signup', 'purchase') THEN k END AS label FROM keyed
), first_seen AS (
 
  SELECT *, row_number() OVER (PARTITION BY split, dataset, filename, label, floor(start_seconds / 3600), label IS NOT NULL AND audio_exists
  ORDER BY source_row) AS nth FROM labelled
), checked AS (
  SELECT *, greatest(0.0, start_seconds) AS clip_start_seconds, least(end_seconds, audio_duration_seconds) AS clip_end_seconds,
    CASE WHEN label IS NULL THEN 'unknown_label_alias:' || label_raw WHEN NOT audio_exists THEN 'missing_audio' WHEN nth > 1 THEN 'duplicate_event'
      WHEN end_seconds - start_seconds <= 0 THEN 'non_positive_duration' WHEN start_seconds >= audio_duration_seconds THEN 'start_after_audio_end'
      WHEN least(end_seconds, audio_duration_seconds) - greatest(0.0, start_seconds) < 0.5 THEN 'too_little_audio' END AS issue FROM first_seen
), manifest AS (SELECT * FROM checked WHERE issue IS NULL)"""
VECTORS_SQL = """vectors AS (SELECT vec_id AS id, 'c' || label AS label, embedding::DOUBLE[] AS features, 'd' || (vec_id % 7) AS domain, vec_id % 5 = 0 AS is_test
  FROM embeddings)"""
PREDICTIONS_SQL = """moved AS (
  SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN (label + vec_id % 4) % 10 ELSE label END AS pred, 0.5 + (vec_id % 50) / 100 AS confidence FROM embeddings
), predictions AS (
  SELECT vec_id AS id, 'd' || (vec_id % 7) AS dataset, 'c' || label AS y_true_label, 'c' || pred AS y_pred_label, confidence AS pred_confidence,
    CASE WHEN pred = label THEN confidence ELSE 1 - confidence END AS true_probability FROM moved
), classes AS (SELECT 'c' || i AS label, i AS label_idx FROM range(10) t(i))"""
INTERVALS_SQL = f"""{ANNOTATIONS_SQL}, intervals AS (
 
  SELECT audio_path, source_row AS gt_id, start_seconds AS start, least(end_seconds, audio_duration_seconds) AS "end", replace(replace(replace(lower(trim(annotation)), '-', ''), '_', ''), ' ', '') AS label
  FROM annotations WHERE end_seconds > start_seconds AND start_seconds < audio_duration_seconds
), detections AS (
 
  SELECT audio_path, gt_id AS pred_id, start + (gt_id % 7 - 3) * 0.1 * ("end" - start) AS start, "end" + (gt_id % 7 - 3) * 0.1 * ("end" - start) AS "end", label, 0.5 + (gt_id % 40) / 100 AS confidence
  FROM intervals WHERE gt_id % 6 <> 0
)"""
