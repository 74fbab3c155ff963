"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breakwater.llm import decontaminate, fill_middle, html_text, langid, licenses, lm_score, merkle, neardup_vectors, packing, simhash, token_counts, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rejected(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.split_and_identify(table(spark, sf_dir, "documents"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.lm_scores(table(spark, sf_dir, "documents"))
    return found.withColumn("log10_score", F.round("log10_score", 4)).withColumn("mean_log10", F.round("mean_log10", 6))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fill_middle.restored(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")])


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_main_text": op2_main_text,
    "op3_near_vectors": op3_near_vectors,
    "op4_toxicity": op4_toxicity,
    "op5_language_id": op5_language_id,
    "op6_lm_scores": op6_lm_scores,
    "op7_packing": op7_packing,
    "op8_simhash": op8_simhash,
    "op9_licenses": op9_licenses,
    "op10_warc": op10_warc,
    "op11_fill_middle": op11_fill_middle,
    "op12_token_counts": op12_token_counts,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op1_decontamination": decontaminate.oracle_sql(),
    "op6_lm_scores": lm_score.oracle_sql(),
    "op9_licenses": licenses.oracle_sql(),
    "op11_fill_middle": fill_middle.oracle_sql(),
    "op13_merkle_manifest": merkle.oracle_sql(),
}
