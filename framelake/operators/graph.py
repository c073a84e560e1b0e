"""Connected components of a table of links."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; a temporary one if unset on a local
    master, elsewhere an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _FALLBACK:
            _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="framelake-"))
        root = _FALLBACK[0]
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, which ends its lineage."""
    path = f"{shared_root(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) of the nodes in links (a, b).

    Each round takes the least label of a node's neighbours and then that label's label, so long chains
    shrink by doubling; no group is gathered.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")))
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        above = labels.select(F.col("node").alias("low"), F.col("label").alias("above"))
        moved = cut(low.join(above, "low").select("node", F.least("low", "above").alias("label"), (F.least("low", "above") < F.col("label")).alias("changed")))
        labels = moved.drop("changed")
        if moved.filter("changed").isEmpty():
            return labels
