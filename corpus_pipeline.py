"""From raw documents to packed training sequences, one operator a stage.

Defined results: a null text fails the quality rules, and so does an empty one; null and repeated doc_ids are
rows like others, in the order of ``keyed``; without labels the rules use their own thresholds; extra columns,
whatever their names, pass through all stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm import exact_dedup, packing, quality_rules, simhash_dedup, suffix_dedup
from tracklens.llm.common import stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays."""
    return simhash_dedup.dedup(docs)


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; documents stay, as empty texts where all of one was repeated."""
    return suffix_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, in sequences: pieces with their token ids, sequence and place there."""
    return packing.pack(docs, with_ids=True)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_dedup", near), ("suffix_dedup", suffixes), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), name)
    return docs
