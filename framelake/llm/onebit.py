"""Nearest neighbours by largest inner product over randomly rotated one-bit codes.

Vectors are centred, scaled to unit length and turned by a random orthogonal matrix. A code keeps the sign of
each coordinate, packed to bits, with two scalars: the length of the centred vector, and the inner product of
the unit vector with its own code. A query q and a centred vector o have

    <q, o> ~ |o| <q', x> / <o', x>

with x the code as +-1/sqrt(D). <q', x> comes from the packed bits, by tables of the query for each byte of a
code. The estimate is unbiased over rotations; its error is below ``BOUND`` * |q'| |o| sqrt((1 - s^2) / s^2 / (D - 1)), s = <o', x>, but for
a small, fixed share of cases. The vectors with the largest estimates are scored in double precision with their
original coordinates; so is every vector whose upper bound reaches the k-th of those scores. The others cannot
be among the k, or only by such a case.

Every row is coded. Queries and candidates meet in blocks of fixed size, so a task holds one block of each;
each block gives k rows a query. Blocks of queries are as large as ``QUERY_BYTES`` allow, since every one of them meets
all candidates. Nothing is gathered on the driver but the mean of the vectors.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither
do rows with a null id; vectors of another size have no inner product with each other, so each size is searched on
its own; equal scores order by the smaller id; rows that repeat an id are candidates each, and of those that ask the
least vector asks; a query never meets rows of its own id; with fewer than k candidates all are returned; vectors of
any size are used whole; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import stored

BOUND = 1.9
#: Bytes of the queries of a block, and candidates in one.
QUERY_BYTES, CANDIDATES = 64 << 20, 8192
#: Queries held against a block at a time; times k, the vectors scored first.
TOGETHER, FIRST = 64, 8
SEED = 7

CODES = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("vector", T.ArrayType(T.DoubleType())),
        T.StructField("code", T.BinaryType()),
        T.StructField("length", T.DoubleType()),
        T.StructField("own", T.DoubleType()),
    ]
)
FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode_vectors(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths of the centred vectors, and inner products of unit vectors with their codes."""
    centred = (x - mean) @ turn
    length = np.linalg.norm(centred, axis=1)
    own = np.abs(centred).sum(axis=1) / (np.sqrt(x.shape[1]) * np.where(length > 0, length, 1))
    return np.packbits(centred > 0, axis=1), length, np.where(length > 0, own, 1)


def code_products(q: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """<q, x> of turned queries and packed codes x = +-1/sqrt(D): a query has a table for each byte of a code,
    of what the 256 patterns of eight signs add up to."""
    dim = q.shape[1]
    signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1
    padded = np.zeros((len(q), 8 * codes.shape[1]), np.float32)
    padded[:, :dim] = q / np.sqrt(dim)
    total = np.zeros((len(q), len(codes)), np.float32)
    for k in range(codes.shape[1]):
        total += (padded[:, 8 * k : 8 * k + 8] @ signs.T)[:, codes[:, k]]
    return total


def nearest_in_block(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, vec_ids: np.ndarray, codes: np.ndarray, length: np.ndarray, own: np.ndarray, mean: np.ndarray, turn: np.ndarray, k: int):
    """For each query, the k best of a block by bounds and rerank: query index, row, score."""
    dim = queries.shape[1]
    turned = queries @ turn
    base, size = queries @ mean, np.linalg.norm(queries, axis=1)
    s = np.clip(own, 1e-9, 1)
    spread = length * np.sqrt(np.maximum(1 - s * s, 0) / (s * s) / max(dim - 1, 1))
    rest, first = min(k, len(vec_ids)), min(FIRST * k, len(vec_ids))
    scale, spread = (length / s).astype(np.float32), (BOUND * spread).astype(np.float32)
    base, size = base.astype(np.float32), size.astype(np.float32)
    out = []
    for at in range(0, len(queries), TOGETHER):
        some = slice(at, at + TOGETHER)
        middle = code_products(turned[some], codes)
        middle *= scale
        middle += base[some, None]
        middle[ids[some, None] == vec_ids[None, :]] = -np.inf
        # The best by estimate, scored exactly, give a bar, the k-th of their scores; all whose upper bound
        # reaches it are scored.
        best = np.argpartition(middle, middle.shape[1] - first, axis=1)[:, middle.shape[1] - first :]
        bar = np.einsum("ij,ikj->ik", queries[some], vectors[best])
        bar = np.where(np.isfinite(np.take_along_axis(middle, best, 1)), bar, -np.inf)
        bar = np.partition(bar, first - rest, axis=1)[:, first - rest]
        middle += size[some, None] * spread
        reach = middle >= np.maximum(bar - 1e-4, -1e30).astype(np.float32)[:, None]
        pairs = []
        for i, wanted in enumerate(reach):
            row = np.flatnonzero(wanted)
            # A product of the chosen rows at once; those that reach the bar are summed one by one, so that
            # equal vectors have equal scores.
            pairs.append(row[vectors[row] @ queries[at + i] >= bar[i] - 1e-9])
        q, row = np.repeat(np.arange(len(pairs)), [len(p) for p in pairs]), np.concatenate(pairs)
        score = np.einsum("ij,ij->i", queries[at + q], vectors[row])
        order = np.lexsort((vec_ids[row], -score, q))
        q, row, score = q[order], row[order], score[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        out.append((at + q[keep], row[keep], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def search(vectors: DataFrame, asks, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest rows to each row for which the column ``asks``
    holds (on ``id_col``, here named vec_id)."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("vector")).filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect()
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in sizes:  # nearly always one
        found = _search(rows.filter(F.size("vector") == r["dim"]), asks, k, r["dim"], r["n"], seed)
        out = found if len(sizes) == 1 else out.unionByName(found)
    return out


def _search(rows: DataFrame, asks, k: int, dim: int, n: int, seed: int) -> DataFrame:
    """The search among ``n`` rows (vec_id, vector) of ``dim`` components."""
    means = rows.select(F.posexplode("vector")).groupBy("pos").agg(F.avg("col").alias("mean")).collect()  # dim rows
    mean, turn = np.zeros(dim), rotation(dim, seed)
    for r in means:
        mean[r["pos"]] = r["mean"]

    def code(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                held = batch["vector"].flatten().to_numpy().reshape(batch.num_rows, dim)
                codes, length, own = encode_vectors(held, mean, turn)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["vector"], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(own)], names=CODES.names)

    index = stored(rows.mapInArrow(code, CODES), "codes")
    n_blocks = max(1, -(-n // CANDIDATES))
    asked = index.filter(asks).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n_queries = asked.count()
    q_blocks = max(1, -(-n_queries * 8 * dim // QUERY_BYTES))
    dealt = F.xxhash64("vec_id")
    left = asked.select("vec_id", "vector", F.pmod(dealt, F.lit(q_blocks)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("c"))
    right = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"), F.pmod(dealt, F.lit(n_blocks)).cast("int").alias("c"))

    def compare(asked, block):
        import pyarrow as pa

        if not asked.num_rows or not block.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

        def matrix(t):
            return t["vector"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, dim)

        ids, vec_ids = asked["vec_id"].to_numpy(), block["vec_id"].to_numpy()
        codes = np.frombuffer(b"".join(block["code"].to_pylist()), np.uint8).reshape(block.num_rows, -1)
        q, row, score = nearest_in_block(matrix(asked), ids, matrix(block), vec_ids, codes, block["length"].to_numpy(), block["own"].to_numpy(), mean, turn, k)
        return pa.table({"query_id": ids[q], "vec_id": vec_ids[row], "score": score})

    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(compare, FOUND)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows a block for a query
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def op10_onebit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)
