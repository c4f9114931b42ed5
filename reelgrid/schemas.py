"""Table contracts. Times are BIGINT nanoseconds, hashes are 64-bit patterns in BIGINT."""

from __future__ import annotations

from pyspark.sql import types as T

RATIONAL = "struct<num:int,den:int>"
COLOR = "struct<range:string,matrix:string,primaries:string,transfer:string>"
POINT = "struct<x:double,y:double>"
MASTERING = (
    f"struct<primaries:struct<red:{POINT},green:{POINT},blue:{POINT},white:{POINT}>,"
    "luminance:struct<min:double,max:double>>"
)

SCHEMAS: dict[str, str] = {
    "media": (
        "media_id string, path string, container string, codec string, stream_index int, width int, "
        f"height int, pixel_format string, time_base {RATIONAL}, avg_rate {RATIONAL}, "
        f"real_rate {RATIONAL}, stream_start_pts bigint, duration_ns bigint, declared_frames bigint, "
        f"bit_depth int, color {COLOR}, "
        "chapters array<struct<id:bigint,start_ns:bigint,end_ns:bigint,title:string>>, "
        "file_size bigint, mtime_ms bigint"
    ),
    "frames": (
        "media_id string, presentation_index bigint, pts bigint, dts bigint, best_effort_pts bigint, "
        "serial bigint, pt_ns bigint, duration_ns bigint, key_frame boolean, picture_type string, "
        f"width int, height int, pixel_format string, color {COLOR}, chroma_location string, "
        f"bit_depth int, mastering {MASTERING}, content_light struct<max_cll:int,max_fall:int>"
    ),
    "planes": (
        "media_id string, presentation_index bigint, width int, height int, channels int, data binary"
    ),
    "samples": (
        "media_id string, presentation_index bigint, pts bigint, pt_ns bigint, duration_ns bigint, "
        "key_frame boolean, motion float, similarity float, scene_score float, duplicate_score float, "
        "content_hash bigint, perceptual_hash bigint, ingest_seq bigint"
    ),
    "detections": (
        "media_id string, kind string, start_ns bigint, end_ns bigint, first_frame bigint, "
        "last_frame bigint, frame_count bigint, score float, match_start_ns bigint, "
        "match_end_ns bigint, match_first_frame bigint, match_last_frame bigint"
    ),
    "markers": (
        "media_id string, marker_id bigint, time_ns bigint, kind string, label string, "
        "category string, note string"
    ),
    "marker_changes": (
        "media_id string, marker_id bigint, time_ns bigint, kind string, label string, "
        "category string, note string, change_seq bigint, op string"
    ),
    "ranges": "media_id string, range_id string, start_ns bigint, end_ns bigint",
    "probes": (
        "media_id string, probe_id bigint, target_ns bigint, bias string, index_hint bigint, "
        "tolerance_ns bigint"
    ),
    "visits": (
        "user_id string, seq bigint, media_id string, presentation_index bigint, pts bigint, "
        "serial bigint, pt_ns bigint, key_frame boolean, picture_type string, action string"
    ),
    "telemetry": "session_id string, seq bigint, metric string, value double, generation bigint",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])
