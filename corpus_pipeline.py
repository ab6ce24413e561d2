"""From raw documents to packed training sequences: toxicity, exact and near duplicates, benchmark leaks, packing."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from visorlake.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from visorlake.llm.common import table
from visorlake.llm.queries import vocabulary
from visorlake.session import settle, ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.without_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"), cosine=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, vocabulary(), vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies),
          ("decontamination", drop_leaks), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each settled in the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The learned score, the Golay search and the latent search have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None
