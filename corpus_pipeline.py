"""The corpus pipeline: documents that are clean, of good quality and unlike each other, mixed to target
weights and encoded. Each stage takes (spark, docs, sf_dir) and reads what the stage before it wrote.

Cases: texts that are null or empty are not toxic, fail the quality rules and so go; rows without an id pass through all
stages like others; equal rows are one group of copies; columns that a stage does not use stay as they are, whatever
their names; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import minhash, mixing, pieces, quality_rules, toxicity
from millrace.llm.common import table
from millrace.llm.registry import piece_model_file
from millrace.shipping import ship_package
from millrace.storage import deleted, new_path

#: Words of a shingle in the near-duplicate stage.
SHINGLE_WORDS = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_documents(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship_package(spark)
    return minhash.keep_one(docs, SHINGLE_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ship_package(spark)
    return mixing.repeat_documents(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoding of every document that is left."""
    ship_package(spark)
    return pieces.encode_documents(docs, piece_model_file())


STAGES = [("toxicity", drop_toxic), ("quality_rules", keep_quality), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("sentencepiece", encode)]

#: Learned models, iterated components and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again; a stage's input goes when its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        frame, path = stage(spark, docs, sf_dir), new_path(spark, f"stage-{name}")
        frame.write.parquet(path)
        docs = spark.read.schema(frame.schema).parquet(path)
        if before is not None:
            deleted(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
