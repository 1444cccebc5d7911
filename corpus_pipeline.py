"""A corpus pipeline over `documents`: toxicity, near duplicates, benchmarks, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again before
the next one starts. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewarden.llm.common import stored
from tracewarden.llm.decontaminate import clean_documents
from tracewarden.llm.mixing import mixed_documents
from tracewarden.llm.neardup import distinct_documents
from tracewarden.llm.packing import with_shards
from tracewarden.llm.toxicity import civil_documents

SHARDS = 40
#: The toxicity stage is a trained network, so SQL cannot express the rows of the whole.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the network, trained on `labels`, rejects."""
    return civil_documents(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are alike to 80% or more."""
    return distinct_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold ten consecutive words of a benchmark item, or a short item."""
    return clean_documents(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: a row per document and pass, with the words that were taken."""
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard; bytes, tokens and rows are balanced."""
    return with_shards(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, each on what the one before it wrote."""
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
