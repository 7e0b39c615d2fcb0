"""Stateless enrichment of streams with the same columns as batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ipaloom.functions import text
from ipaloom.sources.inventory import LANGUAGES, LanguageRegistry


def transcribed(stream: DataFrame, column: str, lang: str = "en") -> DataFrame:
    """``stream`` with ipa and tokens of a text column; works on batches and on streams."""
    ipa = text.spell(F.lower(F.col(column)), LANGUAGES[lang][1])
    return stream.withColumn("ipa", ipa).withColumn("tokens", text.tokenize(F.col("ipa"), LanguageRegistry()[lang].phones))
