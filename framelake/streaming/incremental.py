"""Incremental ingestion: new image files are analysed and appended as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ScanConfig
from ..sources import images
from ..sources import manifest as files

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, root: str, per_trigger: int = 500) -> DataFrame:
    """A stream of files below ``root``, at most ``per_trigger`` to a batch."""
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)


def headers(stream: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Header and EXIF columns of arriving files; pixels need the batch scan's decoder."""
    rows = stream.filter(F.lower("path").rlike("(" + "|".join(e.lower().replace(".", r"\.") for e in config.extensions) + ")$"))
    found = images.analysed(rows.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content"), config)
    return images.finished(found.withColumn("filename", F.element_at(F.split("path", "/"), -1)), config)


def follow(spark: SparkSession, root: str, output: str, checkpoint: str, config: ScanConfig = ScanConfig(), available_now: bool = True) -> StreamingQuery:
    """Append the rows of each batch to the Parquet manifest ``output``; the stream's checkpoint makes a batch
    count once, as its number names its folder and a repeated batch replaces it."""

    def put(batch: DataFrame, number: int) -> None:
        files.conformed(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = headers(arriving(spark, root, config.checkpoint_every), config).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and values of events by window and type; events later than ``late`` are dropped."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
