"""From raw documents to shuffled shards: five stages, each a table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from halocline.llm.decontaminate import drop_contaminated
from halocline.llm.language import UNKNOWN, identify, learn
from halocline.llm.mixing import mix_documents
from halocline.llm.sharding import shard_documents
from halocline.llm.simhash import drop_near_duplicates
from halocline.storage import materialise


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the corpus has labels of; texts without a letter go."""
    at = [f"c{i}" for i in range(len(docs.columns))]
    names = dict(zip(docs.columns, at))
    rows = identify(docs.toDF(*at).withColumnRenamed(names["text"], "text"), learn(docs))
    return rows.where(rows["lang_pred"] != UNKNOWN).drop("lang_pred", "score").toDF(*docs.columns)


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_duplicates(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_documents(docs)


def shuffle_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and the place in it."""
    return shard_documents(docs)


STAGES = [
    ("language", keep_identified),
    ("near-duplicates", keep_one_of_copies),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
    ("sharding", shuffle_into_shards),
]

# Stages rest on models and hashes that SQL doesn't have; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
