"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineseek.llm import (
    decontamination, language, manifest, mixing, quality, secrets, sharding, simhash, statements, substrings, suffixes, tokens,
    urls, whitening,
)
from lineseek.llm.common import documents

TOKENIZER_FOLDER = "/opt/tokenizers"


def tokenizer_path(name: str, folder: str = TOKENIZER_FOLDER) -> str:
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return os.path.join(folder, name)
    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "n_item_tokens", "n_covered", "n_tiles")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).withColumn("quality", F.round("quality", 6))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op10_seen_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_seen(documents(spark, sf_dir))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.check_tampering(documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), [F.col("vec_id")])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_decontamination,
        op3_token_counts,
        op4_quality,
        op5_mixing,
        op6_simhash,
        op7_repeated_bytes,
        op8_secrets,
        op9_sharding,
        op10_seen_windows,
        op11_url_filter,
        op12_manifest,
        op13_whitening,
        pipeline,
    )
}
# Learned models, whole-text windows and links have no SQL; the tests compare these by brute force.
ORACLES: dict[str, str] = statements.statements()
