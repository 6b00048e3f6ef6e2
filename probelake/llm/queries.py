"""The numbered queries over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probelake.llm import collocations, exact_dedup, langid, minhash, mixing, pieces, quality, quality_model, sharding, spelling, suffix, tokenbin, wordpiece
from probelake.llm.sql import SQL, mix_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def numbered(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@numbered
def op1_b_bit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(documents(spark, sf_dir))


# Production parameters of the mix: whole weights by node name, share of the corpus, epochs a leaf may be read.
DOMAINS = ("web", "reference", "forum")  # by the number in a source's name
WEIGHTS = {"domain": {"web": 5, "reference": 3, "forum": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 2, "src1": 4}}
SHARE_PERCENT, MAX_EPOCHS, SEED = 60, 2, 7


def domain_of(source: Column) -> Column:
    number = F.pmod(F.regexp_extract(source, "[0-9]+", 0).try_cast("int"), F.lit(len(DOMAINS)))
    return F.get(F.array(*map(F.lit, DOMAINS)), number)


def word_count(text: Column) -> Column:
    return F.size(quality.words(F.coalesce(text, F.lit(""))))


@numbered
def op2_hierarchical_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), domain_of(F.col("source")), word_count(F.col("text")), SHARE_PERCENT, WEIGHTS, MAX_EPOCHS, SEED)


@numbered
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_lines_removed", "chars_removed")


@numbered
def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(documents(spark, sf_dir), 24).drop("first_id")


@numbered
def op5_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


@numbered
def op6_perfect_hash_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2)


@numbered
def op7_two_stage_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir))


@numbered
def op8_distinct_chunk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), ["n_tokens", "ids_sha256", "decoded_sha256"])


@numbered
def op9_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(documents(spark, sf_dir), *wordpiece.vocabulary(public_tokenizers.path("piece_bpe_32k.model")))


@numbered
def op10_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(documents(spark, sf_dir))


@numbered
def op11_stream_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


@numbered
def op12_nonnegative_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@numbered
def op13_one_edit_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(documents(spark, sf_dir))


SQL["op2_hierarchical_budget"] = mix_sql(WEIGHTS, DOMAINS, SHARE_PERCENT, MAX_EPOCHS, SEED)
