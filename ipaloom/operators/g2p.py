"""Graphemes to phonemes: dictionary, rules, or a model plugged in behind an explicit opt-in."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from enum import Enum

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ipaloom.functions import text
from ipaloom.sources.inventory import LANGUAGES

OPT_IN = "IPALOOM_RESEARCH_G2P"


class Resource(Enum):
    DICTIONARY = "dictionary"
    GENERATOR = "generator"


class ResearchUseOnlyError(RuntimeError):
    pass


def opted_in(flag: bool | None = None) -> bool:
    return flag if flag is not None else os.environ.get(OPT_IN, "").strip().lower() in ("1", "true", "yes", "on")


def from_dictionary(words: DataFrame, dictionary: DataFrame, strict: bool = False) -> DataFrame:
    """``words`` (lang, word) with prons; null where the dictionary has none, an error then if ``strict``."""
    out = words.join(dictionary.select("lang", "word", "prons"), ["lang", "word"], "left")
    return out.withColumn("prons", F.when(F.col("prons").isNull(), F.raise_error(F.concat(F.lit("not in the dictionary: "), "word"))).otherwise(F.col("prons"))) if strict else out


def from_rules(words: DataFrame) -> DataFrame:
    ipa = F.lit(None).cast("string")
    for lang, (_, rules) in LANGUAGES.items():
        ipa = F.when(F.col("lang") == lang, text.spell(F.col("word"), rules)).otherwise(ipa)
    return words.withColumn("prons", ipa)


def phones_for(words: DataFrame, dictionary: DataFrame, resource: Resource | None = None) -> DataFrame:
    """Dictionary, rules, or (None) the dictionary with rules for what it lacks."""
    if resource is Resource.DICTIONARY:
        return from_dictionary(words, dictionary, strict=True)
    if resource is Resource.GENERATOR:
        return from_rules(words)
    found = from_dictionary(words, dictionary).withColumnRenamed("prons", "_found")
    return from_rules(found).withColumn("prons", F.coalesce("_found", "prons")).drop("_found")


def generate(words: DataFrame, load: Callable[[], Callable[[list[str]], tuple[list[str], list[float | None]]]], batch_size: int = 16, research_use: bool | None = None) -> DataFrame:
    """(lang, word, prons, probability) by a model; ``load`` runs once a worker and returns a function of prompts "<lang>: word"."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    if not opted_in(research_use):
        raise ResearchUseOnlyError(f"models are for research use; pass research_use=True or set {OPT_IN}=1")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            prompts = [f"<{a}>: {w}" for a, w in zip(f["lang"], f["word"])]
            got = [model(prompts[i : i + batch_size]) for i in range(0, len(prompts), batch_size)]
            yield f.assign(prons=[p for ps, _ in got for p in ps], probability=[x for _, xs in got for x in xs])

    return words.select("lang", "word").mapInPandas(run, "lang string, word string, prons string, probability double")
