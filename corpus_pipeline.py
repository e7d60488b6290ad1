"""A corpus made ready for training: filtered, deduplicated and packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import exact_dedup, ngram_join, packing, quality, queries, toxicity
from loomgraph.llm.shared import fresh_names, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject."""
    return toxicity.filter_rows(docs, toxicity.fit(queries.taught(spark, sf_dir, "toxic")), threshold=0.5)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.filter_rows(docs, quality.fit(queries.taught(spark, sf_dir, "quality")), threshold=0.3)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles; rows without an id stay."""
    (name,) = fresh_names(docs, "other")
    others = ngram_join.link_classes(docs, n=5, percent=80).filter("doc_id > component_id").select(F.col("doc_id").alias(name)).distinct()
    # Few documents go, as a rule: a written table, so that Spark knows its size and broadcasts it only if it is small.
    return docs.join(written(others, "near-copies"), F.col("doc_id") == F.col(name), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("packing", pack),
]

#: SQL has no word for the learned filters and the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
