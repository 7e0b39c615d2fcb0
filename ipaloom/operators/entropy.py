"""Entropy and utilisation of syllable patterns, by component and jointly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COMPONENTS = ("onset", "nucleus", "coda")


def pattern_counts(words: DataFrame) -> DataFrame:
    """(lang, component, pattern, n) of (lang, syllables, frequency): parts by syllable, the joint pattern by word. Missing parts are no patterns."""
    part = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"s.{c}").alias("pattern")) for c in COMPONENTS])).alias("x")
    parts = words.select("lang", "frequency", F.explode("syllables").alias("s")).select("lang", "frequency", part).select("lang", "x.*", "frequency").where("pattern is not null")
    joint = words.select("lang", F.lit("joint").alias("component"), F.to_json("syllables").alias("pattern"), "frequency")
    return parts.unionByName(joint).groupBy("lang", "component", "pattern").agg(F.sum("frequency").alias("n"))


def entropy(counts: DataFrame) -> DataFrame:
    """(lang, component, entropy, n_patterns, total): two rounds of pre-aggregated sums, H = log2 N - sum(n log2 n) / N."""
    return counts.groupBy("lang", "component").agg(
        (F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"), F.count("*").alias("n_patterns"), F.sum("n").alias("total")
    )


def metrics(words: DataFrame, consonant_bits: int, vowel_bits: int) -> DataFrame:
    """Entropy, patterns, utilisation of the 2^bits possible ones and provisioning (under 25 %: over, over 75 %: under) of every component, with the joint redundancy."""
    bits = F.when(F.col("component") == "nucleus", vowel_bits).when(F.col("component") != "joint", consonant_bits)
    rows = entropy(pattern_counts(words)).withColumn("utilisation", F.col("n_patterns") / F.pow(F.lit(2.0), bits))
    rows = rows.withColumn("provision", F.when(F.col("utilisation") < 0.25, "over").when(F.col("utilisation") > 0.75, "under").when(F.col("utilisation").isNotNull(), "right"))
    w = Window.partitionBy("lang")
    parts = F.sum(F.when(F.col("component") != "joint", F.col("entropy"))).over(w)
    joint = F.max(F.when(F.col("component") == "joint", F.col("entropy"))).over(w)
    return rows.withColumn("redundancy", parts - joint)


def top_patterns(counts: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent patterns of each component."""
    order = Window.partitionBy("lang", "component").orderBy(F.desc("n"), "pattern")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
