"""Evaluation of near-homophones: best variants, recall, recovered words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_variants(pairs: DataFrame, variants: DataFrame, distance) -> DataFrame:
    """(label, distance, ipa_a, ipa_b) of (label, word_a, word_b): the nearest pair of pronunciations; null where a word has none.

    ``distance`` is a column function of two transcriptions.
    """
    v = variants.select("word", "ipa")
    rows = pairs.join(v.select(F.col("word").alias("word_a"), F.col("ipa").alias("ipa_a")), "word_a", "left")
    rows = rows.join(v.select(F.col("word").alias("word_b"), F.col("ipa").alias("ipa_b")), "word_b", "left")
    rows = rows.withColumn("d", F.when(F.col("ipa_a").isNotNull() & F.col("ipa_b").isNotNull(), distance(F.col("ipa_a"), F.col("ipa_b"))))
    return rows.groupBy("label").agg(F.min(F.struct(F.col("d").isNull().alias("none"), "d", "ipa_a", "ipa_b")).alias("x")).select("label", F.col("x.d").alias("distance"), "x.ipa_a", "x.ipa_b")


def recall(found: DataFrame, threshold: float = 0.35) -> DataFrame:
    """(n, hits, missing, recall) of (label, distance)."""
    hit = F.sum(F.when(F.col("distance") <= threshold, 1).otherwise(0))
    return found.agg(F.count("*").alias("n"), hit.alias("hits"), F.sum(F.col("distance").isNull().cast("int")).alias("missing"), (hit / F.count("*")).alias("recall"))


def recovered(segmentations: DataFrame, expected: DataFrame, top: int = 20) -> DataFrame:
    """(phrase, found): whether any of the ``top`` nearest segmentations shares min(2, expected) words with the expected ones.

    ``segmentations``: (phrase, words) in any order, or with distance, by which the nearest are found.
    """
    if "distance" in segmentations.columns:
        order = Window.partitionBy("phrase").orderBy("distance", F.array_join("words", " "))
        segmentations = segmentations.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= top).drop("_rank")
    rows = segmentations.join(expected, "phrase")
    need = F.least(F.lit(2), F.size("expected"))
    return rows.groupBy("phrase").agg(F.max((F.size(F.array_intersect("words", "expected")) >= need)).alias("found"))


def mined(segmentations: DataFrame) -> DataFrame:
    """Segmentations of more than one word."""
    return segmentations.where(F.size("words") > 1)
