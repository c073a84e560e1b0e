"""Shared folders, materialised tables and file access used by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset a temporary folder of this driver is used on a
    local master, as in tests; elsewhere this raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _FALLBACK.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="framelake-"))
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path of its own below the shared folder."""
    return f"{shared_root(spark)}/framelake/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends there.

    The files outlive the executors that wrote them. ``forget`` deletes them.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._framelake_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables of ``stored`` that no later read needs."""
    for df in frames:
        path = getattr(df, "_framelake_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def opened(uri: str):
    """A pyarrow file system and the path in it, for reads and writes in workers."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def chunks(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with at most ``most`` characters each, or a single text."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        if i > begin and held + len(t) > most:
            yield begin, i
            begin, held = i, 0
        held += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def text_of(col: str = "text"):
    """The column as a string; null counts as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
