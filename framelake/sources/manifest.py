"""Manifests as files: JSON lines with a header, Parquet, flat exports, merging."""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..operators.graph import cut
from ..schema import CSV_COLUMNS, DEFAULTS, MANIFEST, META, PARQUET_BASE, PARQUET_NESTED, kind, with_defaults

MARKER = "__manifest_meta__"
SCHEMA_VERSION = 1
#: Blocks of files that are broadcast to number their lines.
BROADCAST_BLOCKS = 200_000


def conformed(rows: DataFrame) -> DataFrame:
    """All manifest columns in order, absent ones with their default; ``row_idx`` is kept."""
    have = set(rows.columns)
    out = [with_defaults(f.name) if f.name in have else F.lit(DEFAULTS.get(f.name)).cast(f.dataType) for f in MANIFEST]
    return rows.select(*[c.alias(f.name) for c, f in zip(out, MANIFEST, strict=True)], *(["row_idx"] if "row_idx" in have else []))


def _text(t: T.DataType) -> T.DataType:
    """The type with text for every value of records: what a line holds never fails to be read."""
    return T.StringType() if not isinstance(t, T.StructType) else T.StructType([T.StructField(f.name, T.StringType()) for f in t])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block and line (ascending by one in a block) of all lines."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path)
    rows = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return rows


def _parsed(lines: DataFrame) -> DataFrame:
    """``lines`` with ``r``, their keys as text, and ``_damaged``. JSON that is no object raises."""
    plain = T.StructType([*[T.StructField(f.name, T.StringType()) for f in MANIFEST], *[T.StructField(n, T.StringType()) for n in (MARKER, *META.names)], T.StructField("_corrupt", T.StringType())])
    lines = lines.filter(F.trim("value") != "")
    value = F.trim("value")
    other = ~value.startswith("{") & F.try_parse_json(value).isNotNull()
    parsed = F.from_json(value, plain, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return lines.withColumn("r", F.when(other, F.raise_error(F.concat(F.lit("a line is JSON but no object: "), F.substring(value, 1, 80)))).otherwise(parsed)).withColumn("_damaged", F.col("r").isNull() | F.col("r._corrupt").isNotNull())


def _typed(c: Column, t: T.DataType) -> Column:
    """Text as a value of a type; what doesn't fit is null. Whole numbers may be written with a fraction."""
    if isinstance(t, T.StructType):
        held = F.from_json(c, _text(t))
        return F.when(c.startswith("{"), F.struct(*[_typed(held[f.name], f.dataType).alias(f.name) for f in t]))
    if isinstance(t, (T.IntegerType, T.LongType)):
        return F.coalesce(c.try_cast(t), c.try_cast("double").try_cast(t))
    return c.try_cast(t)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _numbered(lines: DataFrame) -> DataFrame:
    """``lines`` with ``row_idx``: by append, then file, then place in the file, however Spark packs the files."""
    append = F.coalesce(F.regexp_extract("file", r"/append=(\d+)/", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first"))
    # A row for each block of a file, as many as Spark's driver has read tasks.
    blocks = cut(blocks.withColumn("before", F.sum("n").over(W.orderBy(append, "file", "block")) - F.col("n")).drop("n"))
    if blocks.count() <= BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    return lines.join(blocks, ["file", "block"]).withColumn("row_idx", F.col("before") + F.col("line") - F.col("first")).drop("before", "first")


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header rows and records. Blank and damaged lines, a torn tail too, are skipped; unknown keys dropped;
    absent ones, and values that don't fit their column, defaulted; headers after the first are no records. JSON that
    is no object raises. A missing file has no records.

    ``row_idx`` ascends in the order of appends, files and lines in them.
    """
    if not exists(spark, path):
        empty = spark.createDataFrame([], T.StructType([*MANIFEST.fields, T.StructField("row_idx", T.LongType())]))
        return spark.createDataFrame([], "input_dir string, schema_version int, settings map<string,string>, total_files bigint, created_at string"), empty
    rows = _parsed(_numbered(_lines(spark, path))).filter("not _damaged")
    header = F.coalesce(F.lower(F.col(f"r.{MARKER}")) == "true", F.lit(False))
    settings = F.from_json("r.settings", T.MapType(T.StringType(), T.StringType()))
    meta = rows.filter(header).select(*[(settings if f.name == "settings" else _typed(F.col(f"r.{f.name}"), f.dataType)).alias(f.name) for f in META])
    records = rows.filter(~header).select("row_idx", *[_typed(F.col(f"r.{f.name}"), f.dataType).alias(f.name) for f in MANIFEST])
    return meta, conformed(records)


def damaged(spark: SparkSession, path: str) -> int:
    """Lines that ``read_jsonl`` skips, but blank ones."""
    return _parsed(_lines(spark, path)).filter("_damaged").count()


def meta_line(meta: dict) -> str:
    held = {"schema_version": SCHEMA_VERSION, "total_files": 0, "created_at": datetime.now(UTC).isoformat(), "settings": {}, "input_dir": ""} | meta
    return json.dumps({MARKER: True} | held)


def write_jsonl(rows: DataFrame, path: str, meta: dict, mode: str = "overwrite") -> None:
    """Records as JSON lines below ``path`` and the header as a file of its own, which sorts first."""
    spark = rows.sparkSession
    if mode == "overwrite":
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/records")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    append_jsonl(rows, path)
    write_meta(spark, path, meta)


def write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    """Replace the header; records are untouched and the committer makes the change whole."""
    spark.createDataFrame([(meta_line(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Records as a folder of their own, whose number ascends, so that readers know the order of appends."""
    conformed(rows).drop("row_idx").write.mode("append").json(f"{path}/records/append={_next(rows.sparkSession, path):09d}")


def _next(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/records")
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(p)] if store.exists(p) else []
    return 1 + max([0, *(int(n[7:]) for n in names if n.startswith("append=") and n[7:].isdigit())])


def write_parquet(rows: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = None) -> None:
    """The native form: nested columns, ``row_idx`` stored."""
    writer = rows.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def merge(parts: Iterable[DataFrame]) -> DataFrame:
    """The rows of all parts, as a bag; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge_files(spark: SparkSession, paths: list[str], out: str, meta: dict) -> dict[str, int]:
    """Concatenate partial manifests, leaving out headers, damaged lines and missing files, both counted."""
    found = [p for p in paths if exists(spark, p)]
    bad = sum(damaged(spark, p) for p in found)
    rows = merge([read_jsonl(spark, p)[1].drop("row_idx") for p in found]) if found else read_jsonl(spark, f"{out}/none")[1].drop("row_idx")
    n = rows.count()
    write_jsonl(rows, out, meta | {"total_files": n})
    return {"records": n, "skipped_lines": bad, "missing_parts": len(paths) - len(found)}


def flat_csv(rows: DataFrame) -> DataFrame:
    """Flat columns as text: absent values are empty, booleans True and False."""

    def cell(source: str):
        c = F.col(source)
        text = F.initcap(c.cast("string")) if isinstance(kind(source), T.BooleanType) else c.cast("string")
        return F.coalesce(text, F.lit(""))

    return rows.select(*[cell(source).alias(name) for name, source in CSV_COLUMNS])


def to_csv(rows: DataFrame, path: str) -> int:
    """Write the flat CSV; without rows nothing is written. Returns the number of rows."""
    n = rows.count()
    if n:
        flat_csv(rows).write.mode("overwrite").option("header", "true").option("emptyValue", "").csv(path)
    return n


def flat_parquet(rows: DataFrame) -> DataFrame:
    """Flat columns with dotted names for nested values; absent ones are 0, 0.0, false or empty, the largest
    pixel value 255."""

    def cell(name: str):
        t = kind(name)
        empty = 255 if name.endswith("max_val") else "" if isinstance(t, T.StringType) else False if isinstance(t, T.BooleanType) else 0
        return F.coalesce(F.col(name), F.lit(empty).cast(t)).alias(name)

    return rows.select(*map(cell, (*PARQUET_BASE, *PARQUET_NESTED)))


def to_parquet(rows: DataFrame, path: str) -> None:
    flat_parquet(rows).write.mode("overwrite").parquet(path)


def batches(keys: DataFrame, n: int) -> DataFrame:
    """``keys`` (with row_idx) with the number of their batch of ``n``, in order of row_idx.

    Places come from counts by range of the order, so no task sees all keys.
    """
    keys = cut(keys.repartitionByRange("row_idx").withColumn("part", F.spark_partition_id()))  # ranges are drawn once
    counts = keys.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy("part").orderBy("row_idx")) - 1
    return keys.withColumn("place", place).join(F.broadcast(before), "part").withColumn("batch", F.floor((F.col("before") + F.col("place")) / n).cast("bigint")).drop("part", "place", "before")


def size_estimate(rows: DataFrame, first: int = 100) -> DataFrame:
    """One row: exact total, and the mean of the first sizes times the count, as a whole number."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).cast("bigint").alias("exact_bytes"))
    mean = rows.orderBy("row_idx").limit(first).agg(F.avg("file_size_bytes").alias("mean"))
    both = total.withColumn("one", F.lit(1)).join(mean.withColumn("one", F.lit(1)), "one")
    return both.select("exact_bytes", F.coalesce(F.floor(F.col("mean") * F.col("n")), F.lit(0)).cast("bigint").alias("estimated_bytes"))
