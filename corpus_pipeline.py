"""From raw documents to encoded training text: rules, exact and near deduplication, mixing, encoding.

Every stage takes all rows its predecessor kept and returns the columns of ``documents``; the last one returns the
encoded documents. Stages are written as Parquet and read again, so a lost executor repeats one stage at most.

Defined results: an empty table goes through all stages as an empty table; nulls, ties and repeated rows follow the
operators. The rules replace a text by its lines that pass. A repeated ``doc_id`` with another text is another
document in every stage but the near-duplicate one, where rows of one id stand or fall together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelake.llm import exact_dedup, minhash, mixing, pieces, quality
from probelake.llm.queries import WEIGHTS, domain_of, word_count
from probelake.session import scratch_path

SHARE_PERCENT = 80  # of the tokens that reach the mix; every document is read once at most


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs, domain_of(F.col("source")), word_count(F.col("text")), SHARE_PERCENT, WEIGHTS, max_epochs=1)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ["n_tokens", "ids", "ids_sha256", "decoded_sha256"])


STAGES = [("quality rules", rules), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("pieces", encode)]

ORACLE_SQL = None  # the encoding is not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
