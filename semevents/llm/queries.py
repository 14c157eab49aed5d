"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, kd_shards, language, licenses, lm, neighbours, pieces, quality, tool_chat
from .common import documents

#: The vocabulary file of the piece operators; a path to any SentencePiece model may be given instead.
PIECE_MODEL = os.environ.get("SEMEVENTS_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = pieces.encode_pieces(docs, pieces.read_model(PIECE_MODEL), keep_ids=False, digest=True, keep_text=False)
    return out.select("doc_id", "n_pieces", "ids_crc32", "piece_score", "round_trip")


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.classify(documents(spark, sf_dir))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.classify(documents(spark, sf_dir), pieces.read_model(PIECE_MODEL))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tool_chat.turns_as_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return tool_chat.link_tool_calls(turns, tool_chat.ANSWER)


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.kd_shards(documents(spark, sf_dir), 40)


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_jaccard, op3_lm, op4_decontaminate, op5_licenses, op6_language, op7_quality, op8_tool_chat, op9_neighbours, op10_kd_shards)}
ORACLES = {"op5_licenses": licenses.oracle(), "op8_tool_chat": tool_chat.ORACLE, "op9_neighbours": neighbours.ORACLE}
