"""Manifest rows for tests."""

from framelake.schema import DEFAULTS, MANIFEST
from pyspark.sql import types as T

SCHEMA = T.StructType([*MANIFEST.fields, T.StructField("row_idx", T.LongType())])


def manifest(spark, rows):
    """A manifest of partial rows; path and row_idx count up where they aren't given."""
    full = []
    for i, r in enumerate(rows):
        r = {"path": f"/data/{i}.jpg", "width": 640, "height": 480, "format": "JPEG", "row_idx": i} | r
        r.setdefault("filename", r["path"].rsplit("/", 1)[-1])
        r.setdefault("aspect_ratio", round(r["width"] / r["height"], 4))
        full.append(tuple(r.get(f.name, DEFAULTS.get(f.name)) for f in SCHEMA))
    return spark.createDataFrame(full, SCHEMA)
