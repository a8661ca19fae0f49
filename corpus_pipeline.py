"""A training corpus from raw documents, in five stages; each is written and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redpencil.llm import exact_dedup, jaccard, mixing, packing, queries, toxicity
from redpencil.llm.common import stored

TOXIC_FROM = 0.7
CAPACITY = 4096


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the machine learns from the labelled ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, queries.toxicity_model(docs, labels), TOXIC_FROM)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, the one with the smallest id."""
    return exact_dedup.drop_copies(docs, keep="min")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 on five-word shingles stays, the one with the smallest id."""
    return jaccard.keep_representatives(docs, words=5, num=4, den=5)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens in the shares of the mixture: documents of scarce sources repeat, plentiful sources end early."""
    cut = mixing.cut_texts(queries.mixed(docs))
    whole = F.col("taken") == F.col("tokens")
    return cut.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.char_length("text"))).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of at most 4096 tokens."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY), CAPACITY)


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact dedup", exact_duplicates),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mixture),
    ("best-fit packing", packed_sequences),
]

ORACLE_SQL = None  # a trained machine and a tokenizer stand in the way; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
