"""Pronunciation dictionaries: reading, pre-tokenizing, caching as Parquet."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ipaloom.functions import text
from ipaloom.session import exists, shared_dir, ship, state_of
from ipaloom.sources.inventory import LANGUAGES, Spec

VERSION = 3
#: Markers of entries that the data's makers could not transcribe (fixed values).
UNUSABLE = ("CONSONANTUNACCOUNTEDFOR", "QNOU")
#: Letters of the words that documents are cut into.
LETTERS = "[a-zà-ÿœß]+"


def read_tsv(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """(lang, word, prons) of a file of word, tab, comma-separated pronunciations. Of repeated words the last row holds; a missing file gives no rows."""
    try:
        raw = spark.read.option("sep", "\t").option("quote", "").schema("word string, prons string").csv(path)
    except AnalysisException:
        raw = spark.createDataFrame([], "word string, prons string")
    rows = raw.where(F.col("prons").isNotNull() & F.col("word").isNotNull() & ~F.col("prons").rlike("|".join(UNUSABLE))).withColumn("n", F.monotonically_increasing_id())
    return rows.groupBy(F.lower(F.trim("word")).alias("word")).agg(F.max_by("prons", "n").alias("prons")).select(F.lit(lang).alias("lang"), "word", "prons")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def variants(raw: DataFrame) -> DataFrame:
    """(lang, word, variant, ipa): every pronunciation of every word."""
    return raw.select("lang", "word", F.posexplode(F.split("prons", ",")).alias("variant", "ipa")).withColumn("ipa", F.trim("ipa")).where("ipa != ''")


def words_of(docs: DataFrame, min_length: int = 3) -> DataFrame:
    """(lang, word, frequency): distinct words of documents by their language."""
    words = docs.where(F.col("lang").isNotNull()).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0))).alias("word"))
    return words.groupBy("lang", "word").agg(F.count("*").alias("frequency")).where(F.char_length("word") >= min_length)


def prepared(spark: SparkSession, path: str, specs: dict[str, Spec]) -> DataFrame:
    """(lang, word, frequency, prons, ipa, tokens, n_tok): the dictionary of the documents at ``path``, of words of any length.

    Made once: words are counted, spelled out by the rules of their language and
    cut into phonemes in three steps, each written to the shared folder before the
    next, so that no step's expressions are pushed below the counting or repeated.
    What is there already for the same state of the input is read. Words of
    languages without rules have no prons.
    """
    ship(spark)
    content = "|".join([str(VERSION), state_of(spark, path), *(f"{k}:{','.join(s.phones)}:{LANGUAGES[k][1]}" for k, s in sorted(specs.items()))])
    place = f"{shared_dir(spark)}/ipaloom-dictionary-{hashlib.sha256(content.encode()).hexdigest()[:16]}"
    steps = {"words": lambda _: words_of(spark.read.parquet(path), 1), "spelled": lambda raw: _by_language(raw, specs, _spelled), "entries": lambda raw: _by_language(raw, specs, _cut)}
    if not exists(spark, f"{place}/entries/_SUCCESS"):
        made = None
        for name, step in steps.items():
            step(made).write.mode("overwrite").partitionBy("lang").parquet(f"{place}/{name}")
            made = spark.read.option("basePath", f"{place}/{name}").parquet(f"{place}/{name}")
    columns = "word string, frequency long, prons string, ipa string, tokens array<string>, n_tok int, lang string"
    return spark.read.schema(columns).parquet(f"{place}/entries")


def _by_language(raw: DataFrame, specs: dict[str, Spec], step: Callable[[DataFrame, str, Spec], DataFrame]) -> DataFrame:
    """``step`` on each language's partition, and the other languages' rows without."""
    other = raw.where(~F.col("lang").isin(*specs))
    out = step(other, "", None)
    for key, spec in specs.items():
        out = out.unionByName(step(raw.where(F.col("lang") == key), key, spec))
    return out


def _spelled(rows: DataFrame, key: str, spec: Spec | None) -> DataFrame:
    return rows.withColumn("prons", text.spell(F.col("word"), LANGUAGES[key][1]) if spec else F.lit(None).cast("string"))


def _cut(rows: DataFrame, key: str, spec: Spec | None) -> DataFrame:
    rows = rows.withColumn("ipa", text.clean_phones(F.trim(F.get(F.split("prons", ","), 0))))
    rows = rows.withColumn("tokens", text.tokenize(F.col("ipa"), spec.phones) if spec else F.lit(None).cast("array<string>"))
    return rows.withColumn("n_tok", F.size("tokens"))


def transcribe(words: DataFrame) -> DataFrame:
    """(lang, word, prons): words spelled out by the rules of their language."""
    ipa = F.lit(None).cast("string")
    for lang, (_, rules) in LANGUAGES.items():
        ipa = F.when(F.col("lang") == lang, text.spell(F.col("word"), rules)).otherwise(ipa)
    return words.select(*words.columns, ipa.alias("prons")).where("prons is not null and prons != ''")


def pretokenize(raw: DataFrame, specs: dict[str, Spec], min_tokens: int = 2, clean: bool = True) -> DataFrame:
    """(lang, word, ipa, tokens, n_tok): first pronunciation, cleaned and cut into phonemes; entries under ``min_tokens`` go.

    ``clean`` False leaves marks in, as a look-up without a prepared dictionary does.
    """
    ipa = F.trim(F.get(F.split("prons", ","), 0))
    rows = raw.select("lang", "word", (text.clean_phones(ipa) if clean else ipa).alias("ipa")).where("ipa != ''")
    tokens = F.lit(None).cast("array<string>")
    for key, spec in specs.items():
        tokens = F.when(F.col("lang") == key, text.tokenize(F.col("ipa"), spec.phones)).otherwise(tokens)
    rows = rows.withColumn("tokens", tokens)
    return rows.withColumn("n_tok", F.size("tokens")).where(F.col("n_tok") >= min_tokens)


def inventory_of(entries: DataFrame) -> list[str]:
    """Sorted phonemes that occur; bounded by the languages' inventories."""
    return [r[0] for r in entries.select(F.explode("tokens").alias("t")).distinct().orderBy("t").collect()]


def fingerprint(raw: DataFrame, specs: dict[str, Spec], min_tokens: int) -> str:
    """Digest of the inventories, the parameters and the dictionary's content."""
    content = raw.agg(F.count("*"), F.sum(F.xxhash64("lang", "word", "prons").cast("decimal(38,0)"))).first()
    parts = [VERSION, min_tokens, *content, *(f"{k}:{','.join(s.phones)}" for k, s in sorted(specs.items()))]
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:16]


def save(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").partitionBy("lang").parquet(f"{path}/v{VERSION}")


def load(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{path}/v{VERSION}")
    except AnalysisException as e:
        raise ValueError(f"no dictionary of version {VERSION} at {path}") from e


def cached(spark: SparkSession, raw: DataFrame | Callable[[], DataFrame], specs: dict[str, Spec], path: str, key: str, min_tokens: int = 2, use_cache: bool = True) -> DataFrame:
    """The prepared dictionary from ``path``, made there if it is missing. ``raw`` may be a factory, which a hit never calls; ``key`` names its content (see ``fingerprint``)."""
    place = f"{path}/{key}"
    if use_cache:
        try:
            return load(spark, place)
        except ValueError:
            pass
    entries = pretokenize(raw() if callable(raw) else raw, specs, min_tokens)
    if not use_cache:
        return entries
    save(entries, place)
    return load(spark, place)
