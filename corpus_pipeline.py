"""A corpus pipeline: toxicity, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) with docs in the columns of
``documents`` and returns a DataFrame; run() writes each stage's result to the
shared folder and rereads it as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import jaccard_join, packing, source_mixing, suffix_dedup, toxicity
from tidegauge.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rated = toxicity.score(docs, labels, carry=("lang", "source", "n_chars"))
    return rated.where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one of smallest doc_id stays.

    Empty documents are linked with none and stay, as do those without an id;
    rows that repeat a doc_id stay or go with it.
    """
    gone = jaccard_join.join(docs).where("component_id <> doc_id").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that an earlier document has as well are cut; a document that loses all of its text goes."""
    cut = suffix_dedup.dedup(docs, keep_text=True, carry=("lang", "source"))
    kept = cut.where("n_bytes = 0 or n_removed < n_bytes")
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the mix: each comes as often as its words are taken, rounded by a seeded draw on the part left over."""
    share = source_mixing.mix(docs).groupBy(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("text_key").alias("key")).agg(F.avg("taken").alias("taken"), F.first("size").alias("size"))
    rows = docs.join(share, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("key")))
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(1.0))
    draw = F.pmod(F.xxhash64(F.lit(23), "doc_id", "text"), F.lit(1 << 20)) / (1 << 20)
    whole = F.floor(times + draw).cast("int")
    return rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), whole))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


STAGES = [("toxicity", toxic), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("source mix", mixed), ("packing", packed)]

#: A trained classifier and a tokenizer aren't SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
