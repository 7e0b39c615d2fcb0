"""Distances of all pairs of a stated set, and across languages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ipaloom.functions.distance import edit_distance, normalised, normalised_edit
from ipaloom.functions.features import BitEncoder, distance_matrix, word_bits
from ipaloom.functions.text import tokenize
from ipaloom.sources.inventory import LANGUAGES, LanguageRegistry, Spec, intersect, universal_dict

#: Rows of a set that are broadcast whole; larger ones meet in blocks of BLOCK rows.
LIMIT, BLOCK = 5_000, 2_000


def pairwise(rows: DataFrame, measure, same: float, columns: list[str]) -> DataFrame:
    """(a, b, value) for all pairs of (key, columns...): each unordered pair is measured once and mirrored.

    The result has the square of the rows; beyond LIMIT rows each pair of blocks
    is a group of its own, so that no task and no broadcast grows with the set.
    """
    n = rows.count()
    side = lambda s: [F.col("key").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns]]
    if n <= LIMIT:
        both = rows.select(*side("a")).join(F.broadcast(rows.select(*side("b"))), F.col("a") < F.col("b"))
    else:
        last = -(-n // BLOCK) - 1
        dealt = rows.withColumn("_block", F.pmod(F.xxhash64("key"), F.lit(last + 1)).cast("int"))
        left = dealt.select(F.col("_block").alias("i"), F.explode(F.sequence(F.col("_block"), F.lit(last))).alias("j"), *side("a"))
        right = dealt.select(F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("i"), F.col("_block").alias("j"), *side("b"))
        both = left.join(right, ["i", "j"]).where((F.col("i") < F.col("j")) | (F.col("a") < F.col("b")))
    half = both.select("a", "b", measure(*[F.col(f"{s}_{c}") for c in columns for s in "ab"]).alias("value"))
    mirrored = F.array(F.struct("a", "b", "value"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    found = half.select(F.explode(mirrored).alias("x")).select("x.*")
    return found.union(rows.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(same).alias("value")))


def cross_language(words: DataFrame, metric: str = "edit", specs: Mapping[str, Spec] | None = None) -> DataFrame:
    """(concept, lang_a, lang_b, value) for each unordered pair of languages of every concept of (concept, lang, tokens).

    edit: normalised distance on universal features, in column expressions;
    hamming: similarity of the bit vectors of both languages' joint features.
    A concept's rows meet by a join on it.
    """
    if metric not in ("edit", "hamming"):
        raise ValueError(f"unknown metric {metric!r}")
    specs = specs or {k: LanguageRegistry()[k] for k in LANGUAGES}
    a, b = (words.select("concept", F.col("lang").alias(f"lang_{s}"), F.col("tokens").alias(s)) for s in "ab")
    both = a.join(b, "concept").where("lang_a < lang_b")
    if metric == "edit":
        phones = sorted({p for s in specs.values() for p in s.features})
        index, matrix = distance_matrix({p: universal_dict(p) for p in phones})
        table = F.create_map(*[F.lit(x) for p, i in index.items() for x in (p, i)])
        costs = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in matrix])
        both = both.withColumn("a", F.transform("a", lambda t: table[t])).withColumn("b", F.transform("b", lambda t: table[t]))
        return both.select("concept", "lang_a", "lang_b", normalised(edit_distance(F.col("a"), F.col("b"), costs), F.col("a"), F.col("b")).alias("value"))
    value = F.lit(None).cast("double")
    for x in sorted(specs):
        for y in sorted(specs):
            if x < y:
                joint = intersect(specs[x], specs[y])
                value = F.when((F.col("lang_a") == x) & (F.col("lang_b") == y), equal_share(word_bits(F.col("a"), joint), word_bits(F.col("b"), joint))).otherwise(value)
    return both.select("concept", "lang_a", "lang_b", value.alias("value"))


class Distance:
    """Distances of one language's transcriptions: of columns, and of all pairs of a table (key, ipa)."""

    def __init__(self, spec: Spec, max_syllables: int = 6):
        self.spec, self.max_syllables = spec, max_syllables
        self.index, self.matrix = distance_matrix(spec.features)

    def tokens(self, ipa: Column) -> Column:
        return tokenize(ipa, self.spec.phones)

    def bits(self, ipa: Column) -> Column:
        return word_bits(self.tokens(ipa), self.spec, self.max_syllables)

    def _ids(self, ipa: Column) -> Column:
        table = F.create_map(*[F.lit(x) for p, i in self.index.items() for x in (p, i)])
        return F.transform(self.tokens(ipa), lambda t: table[t])

    def _costs(self) -> Column:
        return F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in self.matrix])

    def hamming(self, a: Column, b: Column) -> Column:
        """Similarity of the words' bit vectors."""
        return equal_share(self.bits(a), self.bits(b))

    def edit_distance(self, a: Column, b: Column, insert: float = 1.0, delete: float = 1.0) -> Column:
        return edit_distance(self._ids(a), self._ids(b), self._costs(), insert, delete)

    def normalised_edit_distance(self, a: Column, b: Column, insert: float = 1.0, delete: float = 1.0) -> Column:
        return normalised(self.edit_distance(a, b, insert, delete), self._ids(a), self._ids(b))

    def pairwise_hamming(self, rows: DataFrame) -> DataFrame:
        return pairwise(rows.select("key", self.bits(F.col("ipa")).alias("bits")), equal_share, 1.0, ["bits"])

    def pairwise_edit_distance(self, rows: DataFrame, normalise: bool = True) -> DataFrame:
        measure = lambda a, b: normalised(edit_distance(a, b, self._costs()), a, b) if normalise else edit_distance(a, b, self._costs())
        return pairwise(rows.select("key", self._ids(F.col("ipa")).alias("ids")), measure, 0.0, ["ids"])


def compare_cross_language(ipa_by_lang: Mapping[str, str], specs: Mapping[str, Spec], metric: str = "edit") -> dict[tuple[str, str], float]:
    """Every unordered pair of languages. edit: normalised distance on universal features; hamming: similarity of bit vectors of the joint language."""
    import re

    from ipaloom.functions.text import alternation

    if metric not in ("edit", "hamming"):
        raise ValueError(f"unknown metric {metric!r}")
    tokens = {k: re.findall(alternation(specs[k].phones), v) for k, v in ipa_by_lang.items()}
    out = {}
    langs = sorted(ipa_by_lang)
    for i, a in enumerate(langs):
        for b in langs[i + 1 :]:
            if metric == "edit":
                out[a, b] = normalised_edit(tokens[a], tokens[b], {p: universal_dict(p) for p in {*tokens[a], *tokens[b]}})
            else:
                enc = BitEncoder(intersect(specs[a], specs[b]))
                x, y = enc.word(tokens[a]), enc.word(tokens[b])
                out[a, b] = 1 - sum(p != q for p, q in zip(x, y)) / len(x) if x else 1.0
    return out


def equal_share(a: Column, b: Column) -> Column:
    """Hamming similarity of two bit strings of one length."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda e: e)) / F.char_length(a)
