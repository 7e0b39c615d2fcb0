"""The ten operators as queries over whole tables, and their DuckDB oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ipaloom.llm import decontam, fingerprint, langid, neardup, packing, pii, quality, secrets_scan, toxicity, urls
from ipaloom.llm.util import read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, ~quality.held_out())
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), added_tokens=True)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_hash", "estimate")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(read(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.groups(read(spark, sf_dir, "documents"), k=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.scan(read(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_key", "scores")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs, ~langid.held_out())
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {f.__name__: f for f in (op1_pii, op2_url_filter, op3_quality, op4_packing, op5_decontamination, op6_fingerprints, op7_near_duplicates, op8_toxicity, op9_secrets, op10_language)}

#: The others have no SQL form; tests/llm holds them against brute force, round trips and held-out labels.
ORACLES = {
    "op2_url_filter": urls.ORACLE_SQL,
    "op5_decontamination": decontam.ORACLE_SQL,
    "op7_near_duplicates": neardup.ORACLE_SQL,
}
