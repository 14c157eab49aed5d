"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semevents.llm import decontaminate, jaccard, language, pieces, quality
from semevents.llm.common import documents, saved
from semevents.llm.queries import PIECE_MODEL

#: A document whose best language has less of the summed probability is rejected.
LEAST_LANGUAGE = 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives 0.5 or more."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_quality(docs, model, score_col="_quality")
    return scored.filter("_quality >= 0.5").select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: those without a letter, or without a language that stands out, go."""
    model = pieces.read_model(PIECE_MODEL)
    langs, p = language.train(docs, model, rows=None)
    named = language.identify(docs, model, langs, p)
    return named.filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_LANGUAGE)).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard.drop_near_duplicates(docs)


def no_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    flagged = decontaminate.flag_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return flagged.filter(F.size("leaks") == 0).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, piece_score of every document that is left."""
    return pieces.encode_pieces(docs.select("doc_id", "text"), pieces.read_model(PIECE_MODEL), keep_text=False)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("decontaminate", no_leaks),
    ("sentencepiece", encoded),
]
#: SQL can express none of the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
