"""From raw documents to packed training sequences: quality rules, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each to the shared folder as Parquet
and reads it again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heatline.llm import packing, pii, quality, simhash
from heatline.llm.common import read_table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the n-gram ratio keep; the target is trusted by the labels table."""
    return quality.kept(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by doc_id, of each group alike in 0.8 of its five-word shingles."""
    return simhash.first_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with pseudonyms for personal data, under the key that the session names (a test key if none)."""
    return pii.stage(docs, pii.configured(spark, pii.TEST_KEY))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece: its ids and its place in a sequence of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packed_sequences", packed_sequences)]

#: Fingerprints, pseudonyms and tokens have no SQL; tests/llm compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
