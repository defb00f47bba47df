"""From raw documents to shards: quality, near duplicates, benchmark leaks, mixture, sharding.

Each stage works on all that the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm.common import Written
from leafmill.llm.decontaminate import remove_leaks
from leafmill.llm.fair_mix import mixed_documents, op7_weights
from leafmill.llm.hilbert_shards import shard_documents
from leafmill.llm.jaccard_join import keep_one
from leafmill.llm.quality_forest import fit_forest, score_quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no anomaly to the forest; null and empty texts fail them.

    Repeated rows are judged alike; without labels, or without documents that have any, the forest rejects nothing.
    """
    forest, threshold = fit_forest(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, forest, threshold, docs.columns, only_kept=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a Jaccard index of 0.8 or more: that of the least id; null ids come first.

    Of rows alike in id and text one stays; texts without words are no group. Ids are integers.
    """
    return keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that they share with benchmark items, ten or more in a row; null texts stay.

    Rows of which these are more than half go. An empty benchmark takes nothing away; repeated rows are cut alike.
    """
    return remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; those without words as often as their place in the queue says.

    Null sources are a source of their own, the last; repeated rows queue one by one. An empty table gives no rows.
    """
    return mixed_documents(docs, op7_weights())


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, with all their columns, and their shard and slot, each copy with a slot of its own.

    A column called like one that sharding adds gives way to it.
    """
    return shard_documents(docs, keep=tuple(docs.columns))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
    ("shards", shards),
]

#: Quality scores come from a forest, which SQL cannot grow.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`.

    Rows with nulls, empty or very long texts, repeated rows and empty tables go through each stage by its operator's
    rules; columns of any other name are carried along. What a stage has written for itself goes once it is stored.
    """
    written = Written(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        mark = Written.written_so_far()
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written.table(docs, name)
            Written.remove_since(mark)
            if i:
                written.drop(STAGES[i - 1][0])
    return docs
