"""A corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Defined cases: documents without text, or without a letter in it, go in the first stage, and if no document has a language all
others stay there; rows with the same text stay once, under the smallest doc_id; rows that share a doc_id are one document to the
second stage; rows without doc_id pass it, and the last two hash their id as "". An empty table gives an empty result with the
same columns. Columns beyond those of documents are kept in all stages, but for one named shard, which the last one sets.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palisade.llm import decontaminate, language_id, minhash_dedup, mixing, sharding
from palisade.llm.common import load, shared_folder


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence stay."""
    return language_id.accepted(docs, language_id.fit(docs))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id."""
    return minhash_dedup.one_of_each(docs)


def stage_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark stay."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that their tokens come near the target shares of sources, languages and topics."""
    return mixing.mixed(docs)


def stage_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets the name of its shard."""
    return sharding.sharded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", stage_language),
    ("near_duplicates", stage_near_duplicates),
    ("benchmark", stage_benchmark),
    ("mixing", stage_mixing),
    ("sharding", stage_sharding),
]

#: Language ID is a trained model, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what each returns is written to the shared folder, read again, and removed once it is used up."""
    docs = load(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        before = path
    return docs
