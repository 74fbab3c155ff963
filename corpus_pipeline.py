"""The corpus pipeline over ``documents``: language, toxicity, near-duplicates, benchmark leaks, packing.

All stages take an empty table to an empty one, keep other columns as they are, judge rows that
repeat alike, and treat documents of equal text alike but for near-duplicates, where the
smallest doc_id stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakwater.llm import common, decontaminate, langid, packing, simhash, toxicity

#: Least language score of a document that stays: a text with letters that is close to no profile goes.
LEAST_SCORE = 0.1
#: Rejected ids that may be broadcast to drop them.
BROADCAST_IDS = 500_000


def _without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``docs`` without the given ids; rows with a null doc_id stay."""
    bad, _ = common.write_table(ids.select("doc_id").where("doc_id is not null").distinct(), name)
    if bad.count() <= BROADCAST_IDS:
        bad = F.broadcast(bad)
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; null texts, texts without a letter and texts close to no profile go.

    A document with a null doc_id stays only if its text is not null.
    """
    found = langid.identify(docs, langid.learn(docs))
    rejected = found.where((F.col("lang_pred") == langid.UNKNOWN) | (F.col("score") < LEAST_SCORE))
    return _without(docs.where("text is not null"), rejected, "no-language")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject stay.

    All rows of a rejected doc_id go; null doc_ids stay; without a document labelled toxic all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, toxicity.rejected(docs, labels), "toxic")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id.

    Of rows that repeat this doc_id one stays. Null and empty texts are copies of each other. A
    group of null doc_ids only keeps one row.
    """
    return simhash.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark text stay.

    All rows of a doc_id with benchmark text go; null doc_ids and null texts stay; an empty
    benchmark removes nothing.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of all documents that are left: a row for each piece of each row, null text as empty."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("toxicity", not_toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each other stage is written to the shared folder and reread."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = common.write_table(stage(spark, docs, sf_dir), name)
        if old:
            common.drop_table(spark, old)
        old = path
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: fingerprints, models and tokens have none; tests/llm compares with brute force.
ORACLE_SQL = None
