"""Fixed schemas of annotations, the event manifest, the issue table and temporal detections."""

from __future__ import annotations

REQUIRED = ("dataset", "filename", "annotation", "annotator", "low_frequency", "high_frequency", "start_datetime", "end_datetime")
ANNOTATION = "dataset string, filename string, annotation string, annotator string, low_frequency double, high_frequency double, start_datetime string, end_datetime string"
MANIFEST = (
    "split", "dataset", "filename", "audio_path", "label", "label_raw", "label_display", "annotator", "low_frequency", "high_frequency", "start_datetime",
        "end_datetime",
    "start_seconds", "end_seconds", "clip_start_seconds", "clip_end_seconds", "duration_seconds", "real_duration_seconds", "audio_duration_seconds",
    "valid_event", "quality_status", "source_annotation", "source_row",
)
ISSUES = ("split", "dataset", "filename", "label_raw", "label", "source", "row", "issue", "start_seconds", "end_seconds", "audio_duration_seconds",
    "real_duration_seconds")
