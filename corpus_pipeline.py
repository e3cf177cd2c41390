"""The corpus pipeline: documents in, sharded documents out.

Every stage takes null keys and texts, empty and very long texts, repeated rows and empty tables;
what it does with them is said at each. All but the last return the columns of its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesengine.llm import decontaminate, minhash, mixing, quality_rules, sharding
from seriesengine.llm.common import table
from seriesengine.session import materialize

SHARDS = 16


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that they reject go.

    Null and empty texts have too few words and go; repeated rows are judged alike; without labels
    nothing but the base rules rejects.
    """
    return quality_rules.keep_good_documents(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup, five words and 0.8: one document of each group stays.

    The one with the smallest key, null keys last; of equal rows one. Texts without words all stay.
    """
    return minhash.drop_near_duplicates(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that overlap with an item in eight tokens or more go.

    Null and empty texts stay, rows repeated under one key and text go together, null and empty
    items match nothing.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents are sampled so that sources, languages and topics meet their weights.

    Half of the tokens are taken in expectation, rare categories whole. Null categories are one
    category; texts without words stay; equal keys are sampled together.
    """
    return mixing.sample_documents(docs)


def sharded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Jump-hash shards: the documents with their ``shard``; null keys go with key 0."""
    return sharding.assign_shards(docs, "doc_id", SHARDS)


STAGES = [
    ("quality_rules", good_documents),
    ("near_dedup", distinct_documents),
    ("decontamination", clean_documents),
    ("mixing", mixed_documents),
    ("sharding", sharded_documents),
]

#: SQL cannot express MinHash groups or raking.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
