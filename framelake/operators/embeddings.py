"""Vector analytics: centroid, outliers, semantic duplicates, projection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .statistics import percentiles

OUTLIER_SHARE, SIMILARITY = 0.05, 0.95
#: Rows of a block that is held against another.
BLOCK = 4096


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norms(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    return vectors.select(id_col, F.round(F.sqrt(dot(doubles(F.col(col)), doubles(F.col(col)))), 6).alias("norm"))


def normalised(v: Column) -> Column:
    v = doubles(v)
    return F.transform(v, lambda x: x / F.sqrt(dot(v, v)))


def mean_vector(vectors: DataFrame, col: str = "embedding") -> DataFrame:
    """pos (from 0) and mean: as many rows as dimensions."""
    return vectors.select(F.posexplode(doubles(F.col(col)))).groupBy("pos").agg(F.avg("col").alias("mean"))


def centroid(vectors: DataFrame, col: str = "embedding") -> DataFrame:
    """pos and value of the mean vector scaled to unit length."""
    held = sorted((r["pos"], r["mean"]) for r in mean_vector(vectors, col).collect())
    size = sum(m * m for _, m in held) ** 0.5 or 1.0
    return vectors.sparkSession.createDataFrame([(p, m / size) for p, m in held], "pos int, value double")


def outliers(vectors: DataFrame, share: float = OUTLIER_SHARE, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """Rows whose similarity to the centroid lies below its percentile ``share`` (strictly)."""
    held = [r["value"] for r in centroid(vectors, col).orderBy("pos").collect()]
    rows = vectors.select(id_col, dot(doubles(F.col(col)), F.array(*map(F.lit, held))).alias("similarity"))
    limit = percentiles(rows, "similarity", [share])[0]
    return rows.filter(F.col("similarity") < F.lit(limit))


def semantic_pairs(vectors: DataFrame, threshold: float = SIMILARITY, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """a < b and similarity of all pairs at or above the threshold.

    Rows are dealt to blocks of fixed size; each two blocks meet once, as matrices, in one task.
    """
    n = vectors.count()
    blocks = max(1, -(-n // BLOCK))
    rows = vectors.select(F.col(id_col).alias("id"), doubles(F.col(col)).alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"))
    meets = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least("block", k).alias("lo"), F.greatest("block", k).alias("hi")))
    dealt = rows.withColumn("meet", F.explode(meets)).select("meet.*", "id", "v", "block")

    def compare(table):
        import pyarrow as pa

        ids, block = table["id"].to_numpy(), table["block"].to_numpy()
        x = np.array(table["v"].to_pylist(), dtype=float)
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        out = []
        for at in range(0, len(left), 512):
            part = left[at : at + 512]
            sims = x[part] @ x[right].T
            i, j = np.nonzero((sims >= threshold) & ((ids[part][:, None] < ids[right][None, :]) if lo == hi else (ids[part][:, None] != ids[right][None, :])))
            out.append((np.minimum(ids[part][i], ids[right][j]), np.maximum(ids[part][i], ids[right][j]), sims[i, j]))
        a, b, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": a, "b": b, "similarity": s})

    return dealt.groupBy("lo", "hi").applyInArrow(compare, "a long, b long, similarity double")


def project(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """Two principal components: id, x, y. Stands in for a manifold projection, which Spark lacks."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(id_col, array_to_vector(doubles(F.col(col))).alias("v"))
    xy = vector_to_array(F.col("p"))
    return PCA(k=2, inputCol="v", outputCol="p").fit(rows).transform(rows).select(id_col, xy[0].alias("x"), xy[1].alias("y"))


def clip(model: str = "ViT-B-32", pretrained: str = "laion2b_s34b_b79k", device: str | None = None) -> Callable[[], Callable[[list[bytes | None]], np.ndarray]]:
    """A loader of an image encoder for ``compute``. The packages it needs are optional; without them this raises."""
    try:
        import open_clip  # noqa: F401
        import torch  # noqa: F401
    except ImportError as e:
        raise ImportError("embeddings need the packages open_clip and torch, or an encoder of your own (--encoder module:function)") from e

    def load() -> Callable[[list[bytes | None]], np.ndarray]:
        import io

        import open_clip
        import torch
        from PIL import Image

        where = device or ("cuda" if torch.cuda.is_available() else "cpu")
        net, _, prepare = open_clip.create_model_and_transforms(model, pretrained=pretrained, device=where)
        net.eval()

        def encode(contents: list[bytes | None]) -> np.ndarray:
            held = []
            for c in contents:
                try:
                    held.append(prepare(Image.open(io.BytesIO(c or b"")).convert("RGB")))
                except Exception:  # noqa: BLE001 an unreadable image counts as black
                    held.append(prepare(Image.new("RGB", (224, 224))))
            with torch.no_grad():
                return net.encode_image(torch.stack(held).to(where)).float().cpu().numpy()

        return encode

    return load


def compute(images: DataFrame, load: Callable[[], Callable[[list[bytes | None]], np.ndarray]], batch: int = 32) -> DataFrame:
    """path and embedding of images (path, content), in batches, unit length.

    ``load`` gives an encoder in each worker: a function from contents (None where unreadable, which counts
    as an all-zero image) to a matrix.
    """
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = load()
        for held in batches:
            for at in range(0, held.num_rows, batch):
                part = held.slice(at, batch)
                x = np.asarray(encode(part["content"].to_pylist()), dtype=np.float32)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([part["path"], pa.array(list(x), pa.list_(pa.float32()))], names=["path", "embedding"])

    return images.select("path", "content").mapInArrow(task, schema)


def save(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def from_npz(spark, path: str) -> DataFrame:
    """Import an archive with arrays ``embeddings`` and ``paths``, which one machine wrote."""
    with np.load(path, allow_pickle=False) as held:
        rows = [(str(p), [float(v) for v in e]) for p, e in zip(held["paths"], held["embeddings"], strict=True)]
    return spark.createDataFrame(rows, "path string, embedding array<float>")
