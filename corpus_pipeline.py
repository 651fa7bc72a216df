"""The training-data pipeline: stages that each take and return the columns of documents, but for the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontam, mixing, sharding, simhash, toxicity
from lectern.llm.common import read, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out what the field, trained on the labelled ones of these documents, predicts as toxic. Null and empty texts hold no toxic word and stay; repeated rows stay or go
    together; without labels nothing goes; an empty table stays empty."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest id. Texts without words, null and empty ones among them, have the same fingerprint and are one
    group; of repeated rows one stays; an empty table stays empty."""
    return simhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold too much of the benchmark. Null and empty texts hold nothing of it and stay; an empty benchmark drops nothing."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their target weights. A null source is a source of its own, the last one; null and empty texts have size 0."""
    return mixing.apply_mix(docs)


def deal_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row that is left, with its id and size. Equal texts, null ones among them, share a shard; an empty table gives no rows."""
    return sharding.shard(docs).drop("grown_shard").withColumn("size", F.col("size").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_into_shards),
]

#: The toxicity model and the hashes can't be written in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
