"""Bounded, deterministic samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a sample may hold at most; a broadcast of their ids stays under a megabyte.
BOUND = 20_000
#: Characters of the longest text that is learned from, and of a whole sample.
LONGEST, CHARS = 400_000, 40_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, learn: Column, size: int) -> DataFrame:
    """(doc_id, text, y) of at most ``size`` rows of labelled documents, those with the smallest hash, with CHARS characters in all.

    ``learn`` says which rows of ``labels`` may be learned from. Rows with a null
    id or label are left out; of repeated labels the largest holds; a repeated
    row is one example; rows with one id and several texts are as many, within
    ``size``. Texts over LONGEST characters are scored but not learned from.
    """
    if size > BOUND:
        raise ValueError(f"a sample holds at most {BOUND} documents")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & learn).groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("_n", F.char_length("text")).where(F.col("_n") <= LONGEST)
    order = [F.xxhash64("doc_id", "text"), F.col("doc_id"), F.col("text")]
    rows = rows.dropDuplicates(["doc_id", "text"]).orderBy(*order).limit(size)
    # one partition, of ``size`` rows at most
    total = F.sum("_n").over(Window.partitionBy().orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_total", total).where(F.col("_total") <= CHARS).select("doc_id", "text", "y")
