"""From documents to training tokens: quality, near duplicates, mixture, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. The quality stage drops
texts that importance resampling rejects; near-duplicate groups keep their smallest id (five-word shingles,
similarity 0.8); the mixture takes prefixes of one seeded epoch of each source to target weights; the last
stage gives token ids with the bytes they end at, and digests of the ids and of the decoded bytes.

Defined cases, of all stages: null and empty texts have no words, so the quality stage drops them; a null id is a
document of its own that no other stands for; of repeated rows (equal id and text) one is left; rows that share an id
but not a text are judged each by its own; equal keys at a cut go together; texts of any length are read whole; columns
beyond those of documents are passed on up to the last stage, whatever their names; empty documents give no rows, and
without labels the quality stage keeps all texts that have words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import bpe, hyperminhash, importance, mixing
from framelake.llm.common import stored

#: Share of the tokens left by the stages before it that the mixture may take.
MIXED_SHARE = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return importance.sampled(docs, labels).filter("selected").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hyperminhash.deduplicated(docs, k=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, share=MIXED_SHARE, max_epochs=1).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.tokens(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("mixing", mixture), ("bpe", tokens)]

#: The quality and near-duplicate stages can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
