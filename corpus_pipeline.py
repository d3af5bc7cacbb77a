"""The corpus pipeline: language identification, near-duplicates, decontamination, mixing, sharding.

Each stage reads what the one before kept; all but the last return the columns of documents as they came. Empty tables
pass through. Rows that repeat an id are kept or dropped together, except by the mixture, which emits rows as often as
it takes them. The last stage returns all columns, and shard, slot and copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import decontamination, language, mixing, near_dedup, sharding
from blockloom.llm.common import Scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letter, or no learned language clearly likelier than chance."""
    model = language.train(language.learnable(docs))
    found = language.identify(spark, F.col("text"), model)
    return docs.where(found.getField("score") >= language.REJECT_BELOW) if model.languages else docs.where(F.col("text").rlike(r"\p{L}"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each component at similarity 0.8 or more."""
    drop = near_dedup.near_duplicates(docs, percent=80).where("NOT kept").select("doc_id").distinct()
    drop = Scratch(spark, "drop").write(drop, "ids")  # of known size, so that few ids are broadcast and texts stay where they are
    return docs.join(drop, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its edit budget."""
    return decontamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's rate says."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each row its shard, its slot there, and its number among copies of one id and text."""
    return sharding.with_shards(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Trained models, edit distances and label propagation aren't expressible in SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
