"""Tables of the event store."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "array<int>": T.ArrayType(T.IntegerType()),
}


def _table(columns: str) -> T.StructType:
    return T.StructType([T.StructField(*(name, _KINDS[kind])) for name, kind in (c.split() for c in columns.split(", "))])


RUNS = _table(
    "run_id string, pipeline_version string, config_hash string, model_versions string, started_at string, finished_at string, "
    "total_videos bigint, total_events bigint, speed_ratio double, status string, startup_seconds double, export_seconds double"
)
CLIPS = _table(
    "clip_id string, run_id string, file_path string, file_hash string, duration_sec double, total_frames bigint, "
    "processed_events bigint, status string, started_at string, completed_at string, wall_clock_seconds double, speed_ratio double, "
    "decode_seconds double, vehicle_detection_seconds double, plate_detection_seconds double, ocr_seconds double, "
    "staging_seconds double, file_hash_seconds double, clock_read_seconds double"
)
EVENTS = _table(
    "event_id string, processing_run_id string, video_source string, clip_hash string, event_timestamp double, datetime_str string, "
    "best_vehicle_timestamp double, best_plate_timestamp double, direction string, vehicle_type string, plate_raw string, "
    "plate_normalized string, plate_corrected string, plate_correction_reason string, plate_status string, "
    "confidence_vehicle double, confidence_plate double, confidence_ocr double, confidence_consensus double, "
    "vehicle_crop_path string, plate_crop_path string, ocr_votes string, track_id bigint, line_id string, dedup_key string, duplicate_of string"
)
GROUND_TRUTH = _table(
    "ground_truth_id string, video_source string, approx_timestamp double, approx_datetime string, direction string, "
    "vehicle_type string, description string, plate_text string, plate_legible boolean, province string"
)
AUDIT = _table(
    "row_idx int, plate_text string, vehicle_type string, time_cam1 string, time_cam2 string, note string, province string"
)
MANIFEST = _table(
    "event_id string, candidate_idx int, timestamp double, bbox array<int>, padded_bbox array<int>, quality_score double, "
    "det_conf double, plate_crop_path string, vehicle_crop_path string"
)
#: Values that a column takes where a written row leaves it out.
DEFAULTS = {
    "total_videos": 0, "total_events": 0, "processed_events": 0, "speed_ratio": 0.0, "startup_seconds": 0.0, "export_seconds": 0.0,
    "wall_clock_seconds": 0.0, "decode_seconds": 0.0, "vehicle_detection_seconds": 0.0, "plate_detection_seconds": 0.0,
    "ocr_seconds": 0.0, "staging_seconds": 0.0, "file_hash_seconds": 0.0, "clock_read_seconds": 0.0, "confidence_plate": 0.0,
    "confidence_ocr": 0.0, "confidence_consensus": 0.0,
}
