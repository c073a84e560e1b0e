"""Schemas of the manifest, boxes and results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def fields(text: str, **more: T.DataType) -> T.StructType:
    """A schema from ``name type`` pairs, without a session; ``more`` are types by name."""
    kinds = _KINDS | more
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (part.split() for part in text.split(","))])


PIXEL_STATS = fields("mean_r double, mean_g double, mean_b double, std_r double, std_g double, std_b double, mean_brightness double, min_val int, max_val int")
CORNER_STATS = fields("corner_mean double, center_mean double, border_mean double, delta double")

MANIFEST = fields(
    "path string, filename string, file_size_bytes bigint, mtime double, width int, height int, format string, color_mode string, num_channels int, aspect_ratio double, "
    "camera_make string, camera_model string, lens_model string, focal_length_mm double, focal_length_35mm int, iso_speed int, f_number double, exposure_time_sec double, datetime_original string, "
    "orientation_tag int, has_gps_data boolean, distortion_risk string, pixel_stats pixels, corner_stats corners, phash string, dhash string, blur_score double, is_blurry boolean, is_corrupt boolean, "
    "is_dark boolean, is_overexposed boolean, has_border_artifact boolean, analyzed_at string, analyzer_version string",
    pixels=PIXEL_STATS,
    corners=CORNER_STATS,
)
#: Columns that aren't null, with the value an absent one has.
DEFAULTS = {
    "path": "", "filename": "", "file_size_bytes": 0, "mtime": 0.0, "width": 0, "height": 0, "format": "", "color_mode": "", "num_channels": 0, "aspect_ratio": 0.0, "has_gps_data": False,
    "is_blurry": False, "is_corrupt": False, "is_dark": False, "is_overexposed": False, "has_border_artifact": False, "analyzed_at": "", "analyzer_version": "1",
}
META = fields("input_dir string, schema_version int, settings settings, total_files bigint, created_at string", settings=T.MapType(T.StringType(), T.StringType()))
BOXES = fields("image string, class_id int, class_name string, x double, y double, w double, h double, area double")

_BASE = ("path", "filename", "file_size_bytes", "mtime", "width", "height", "format", "color_mode", "num_channels", "aspect_ratio", "camera_make", "camera_model", "lens_model", "focal_length_mm", "focal_length_35mm", "iso_speed", "f_number", "exposure_time_sec", "datetime_original")
_FLAGS = ("has_gps_data", "distortion_risk", "phash", "dhash", "blur_score", "is_blurry", "is_corrupt", "is_dark", "is_overexposed", "has_border_artifact", "analyzed_at")
#: Flat CSV columns: name and source.
CSV_COLUMNS: tuple[tuple[str, str], ...] = (
    *((c, c) for c in (*_BASE, *_FLAGS)),
    *((c, f"pixel_stats.{c}") for c in ("mean_r", "mean_g", "mean_b", "std_r", "std_g", "std_b", "mean_brightness")),
    *((n, f"corner_stats.{c}") for n, c in (("corner_mean", "corner_mean"), ("center_mean", "center_mean"), ("border_mean", "border_mean"), ("corner_delta", "delta"))),
)
#: Flat Parquet columns; the last two groups keep dotted names.
PARQUET_BASE = (*_BASE, "orientation_tag", *_FLAGS)
PARQUET_NESTED = (*(f"pixel_stats.{f.name}" for f in PIXEL_STATS), *(f"corner_stats.{f.name}" for f in CORNER_STATS))


def kind(name: str) -> T.DataType:
    """The type of a column or dotted field of the manifest."""
    at: T.DataType = MANIFEST
    for part in name.split("."):
        at = at[part].dataType
    return at


def with_defaults(name: str) -> Column:
    """A manifest column, absent values replaced where the schema has a default."""
    return F.coalesce(F.col(name), F.lit(DEFAULTS[name]).cast(kind(name))) if name in DEFAULTS else F.col(name)
