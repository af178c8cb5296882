"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import langid, media, minhash, mixing, pieces, quality_rules, quality_score, sharding, tool_calls, toxicity
from millrace.llm.common import table
from millrace.llm.training import fold_of

Query = Callable[[SparkSession, str], DataFrame]
PIECE_MODEL = "piece_bpe_32k.model"


def piece_model_file(name: str = PIECE_MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), piece_model_file())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs, fold_of("doc_id", 4) != 2))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_score.score(docs, quality_score.train(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", 5) != 0))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 40)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 2)


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link_calls(*tool_calls.turn_calls(table(spark, sf_dir, "conversations")), tool_calls.REPLY)


OPERATORS = (op1_sentencepiece, op2_quality_rules, op3_media, op4_language, op5_mixing, op6_toxicity, op7_quality_score, op8_sharding, op9_minhash, op10_tool_calls)


def queries() -> dict[str, Query]:
    import corpus_pipeline

    return {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op8_sharding": sharding.ORACLE_40, "op10_tool_calls": tool_calls.ORACLE}
