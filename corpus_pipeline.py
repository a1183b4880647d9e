"""From raw documents to token ids in five stages.

Each stage is one operator of ``tessera.llm``; its output is written as Parquet
and read as the next one's input, so a lost executor costs one stage at most.

Defined results: a null text counts as empty everywhere. Each stage decides for rows by
doc_id and text, null doc_ids included, so rows with a null doc_id are judged by their
text; a row that is there several times stays or goes as a whole. Of equal texts the
largest doc_id stays, of near-duplicates the smallest; rows with null doc_ids only, and
texts without words, are no near-duplicates of anything. Null sources and languages are
mixed as one category of their own. Empty tables give empty tables, without labels every
document passes the first stage (its score is 0.5). Columns of any name pass through all
stages; the last adds ids, n_ids, ids_crc32 and round_trip, in the place of columns that
have these names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exactdedup, mixing, neardup, pieces, quality
from tessera.llm.staging import Stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts; it learns from the labelled ones of docs."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id."""
    return exactdedup.keep_first_owner(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id."""
    return neardup.keep_one_of_group(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of which the token shares follow the targets: the largest that does, and a
    tenth of the tokens at least (see ``mixing``)."""
    return mixing.sampled(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their SentencePiece ids."""
    return pieces.encoded_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: SQL can express neither the trained classifier nor the token path.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage.save(step(spark, docs, sf_dir), name)
    return docs
