"""From raw documents to packed sequences, in five stages that each work on all that the one before kept.

Defined cases: a null text and an empty text have no words, so the rules reject them; an empty table
stays empty through all stages; rows that repeat an id go through the first two stages each by itself,
then rows that repeat id and text become one, and an id stays if one of its texts stands for its group;
a null id is never removed as a near-duplicate; columns beside those of ``documents`` are dropped by
the first stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import packing, quality, quality_rules, simhash, substring_dedup
from tallyforge.llm.common import fresh_path, made, remove_made, stored_at, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules do not reject."""
    return quality_rules.keep_by_rules(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints of five-word shingles within three bits, the smallest id stays."""
    return simhash.drop_near_duplicates(docs, shingle=5).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the word windows of documents with smaller ids; a text that loses nothing stays as it is."""
    return substring_dedup.keep_unrepeated(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all kept documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", rules),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeats),
    ("packing", packed),
]

#: Training a network and hashing by XXH64 have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs, first = table(spark, sf_dir, "documents"), len(made)
    for name, stage in STAGES:
        at = fresh_path(spark, name)
        docs = stored_at(stage(spark, docs, sf_dir), at)
        remove_made(spark, first, at)  # the stage before and what this one stored meanwhile
    return docs
