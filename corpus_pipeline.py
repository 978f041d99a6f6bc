"""The corpus pipeline: stages over the documents, each written and read again.

Quality classifier, near duplicates, mixing of sources, packing. Every stage but the
last returns documents with all their columns; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import stored, table
from riskloom.llm.mixing import mixed_documents
from riskloom.llm.ngram_join import row_key, similar_groups
from riskloom.llm.packing import pack_documents
from riskloom.llm.quality import drawn_documents, fit_resampler


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws; labels come from the table."""
    return drawn_documents(docs, fit_resampler(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    kept = similar_groups(docs).where("stays").select(F.col("row_key").alias("__row_key"))
    keyed = docs.withColumn("__row_key", row_key(docs))
    # Both steps need the same partitions: texts are shuffled once.
    return keyed.join(kept, "__row_key", "left_semi").dropDuplicates(["__row_key"]).drop("__row_key")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("source_mixing", mix),
    ("packing", pack),
]
#: Importance weights, 64-bit hashes of sets and tokenizers have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, each stage written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
