"""A corpus in five stages: quality, near duplicates, benchmark passages, mix, shards.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns
of documents. Null texts are empty texts to every stage; each operator's docstring tells what it does with nulls, ties
and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import read, stored
from tessera.llm.decontamination import decontaminate
from tessera.llm.mixing import mix
from tessera.llm.neardup import keep_one
from tessera.llm.quality import keep_good
from tessera.llm.sharding import SHARDS, shard


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours vote for quality."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near duplicates."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in random order."""
    return mix(docs).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every copy."""
    return shard(docs, SHARDS)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: SQL can't express the classifier; each stage is tested against the operator that it calls, and the n-gram join and the
#: winnowing below it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of the mixed corpus; what each stage returns is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
