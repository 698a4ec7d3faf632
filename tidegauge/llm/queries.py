"""The queries of this subpackage, as registered in __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracles import ORACLES


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_curve_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .curve_search import search

    return search(_read(spark, sf_dir, "embeddings"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files

    return token_files.read(spark, token_files.write(_read(spark, sf_dir, "documents"), _tokenizer(), end_id=2))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import join

    return join(_read(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup

    return dedup(_read(spark, sf_dir, "documents"))


def op5_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrase_dedup import dedup

    return dedup(_read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), _tokenizer(), end_id=1)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_mixing import mix

    return mix(_read(spark, sf_dir, "documents")).drop("text_key")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bloom_lm import score

    return score(_read(spark, sf_dir, "documents"))


def op10_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_search import search

    return search(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
