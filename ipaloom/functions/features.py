"""Feature distances and bit vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ipaloom.sources.inventory import Spec, universal


def feature_distance(a: Mapping, b: Mapping) -> float:
    """Share of the keys of either mapping whose values differ; an absent key is a value of its own."""
    keys = a.keys() | b.keys()
    return sum(a.get(k) != b.get(k) for k in keys) / len(keys) if keys else 0.0


def map_distance(a: Column, b: Column) -> Column:
    """``feature_distance`` of two map columns."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.when(F.size(keys) == 0, F.lit(0.0)).otherwise(F.size(F.filter(keys, lambda k: ~a[k].eqNullSafe(b[k]))) / F.size(keys))


def universal_distance(a: str, b: str) -> float:
    """Share of the features that are set in both whose values differ; 0 if there are none."""
    both = [(x, y) for x, y in zip(universal(a), universal(b)) if x and y]
    return sum(x != y for x, y in both) / len(both) if both else 0.0


def vector_distance(a: Column, b: Column) -> Column:
    """``universal_distance`` of two array columns."""
    n = F.aggregate(F.zip_with(a, b, lambda x, y: ((x != 0) & (y != 0)).cast("int")), F.lit(0), lambda s, x: s + x)
    d = F.aggregate(F.zip_with(a, b, lambda x, y: ((x != 0) & (y != 0) & (x != y)).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(n == 0, F.lit(0.0)).otherwise(d / n)


def distance_matrix(features: Mapping[str, Mapping], extra: Sequence[str] = ()) -> tuple[dict[str, int], np.ndarray]:
    """Index of every phoneme and the matrix of distances. ``extra``: phonemes without features; two of those are alike."""
    names = [*features, *(p for p in dict.fromkeys(extra) if p not in features)]
    m = np.array([[feature_distance(features.get(a, {}), features.get(b, {})) for b in names] for a in names]).reshape(len(names), len(names))
    return {p: i for i, p in enumerate(names)}, m


def bits_of(features: Mapping, columns: Sequence[str]) -> str:
    """A phoneme's features as a string of bits. A column name=value asks for the value; another is true if set, or if some value is its name."""
    out = []
    for c in columns:
        if "=" in c:
            name, value = c.split("=")
            bit = features.get(name) == value
        else:
            value = features.get(c, False)
            bit = c in features.values() or (not isinstance(value, str) and bool(value) and not (isinstance(value, int) and value < 0))
        out.append("01"[bool(bit)])
    return "".join(out)


def _or(a: int, b: int) -> int:
    return a | b


class BitEncoder:
    """Bit vectors of syllables and words of one language."""

    def __init__(self, spec: Spec):
        self.spec = spec
        self.c, self.v = len(spec.consonant_columns), len(spec.vowel_columns)
        self.consonant = {p: int(bits_of(f, spec.consonant_columns) or "0", 2) for p, f in spec.features.items()}
        self.vowel = {p: int(bits_of(f, spec.vowel_columns) or "0", 2) for p, f in spec.features.items()}

    def syllables(self, tokens: Sequence[str]) -> list[dict[str, str]]:
        """Each run of vowels with the consonants before it, or'ed; only the last keeps a coda, and parts without a bit are left out."""
        runs: list[tuple[int, int]] = []
        onset = nucleus = 0
        in_vowel = False
        for t in tokens:
            if t in self.spec.vowels:
                nucleus, in_vowel = (nucleus | self.vowel[t], True)
            else:
                if in_vowel:
                    runs.append((onset, nucleus))
                    onset = nucleus = 0
                    in_vowel = False
                onset |= self.consonant.get(t, 0)
        if in_vowel:
            runs.append((onset, nucleus))
            onset = 0
        coda = onset if runs else 0
        out = []
        for i, (o, n) in enumerate(runs):
            s = {"nucleus": format(n, f"0{self.v}b")}
            if o:
                s["onset"] = format(o, f"0{self.c}b")
            if coda and i == len(runs) - 1:
                s["coda"] = format(coda, f"0{self.c}b")
            out.append(s)
        return out

    def word(self, tokens: Sequence[str], max_syllables: int = 6) -> str:
        """Last syllables first, their parts end to end, zeros behind."""
        parts = [s.get(k, "") for s in self.syllables(tokens)[::-1][:max_syllables] for k in ("onset", "nucleus", "coda")]
        width = self.spec.syllable_bits * max_syllables
        return "".join(parts).ljust(width, "0")[:width]

    def fold(self, bits: str) -> str:
        """All syllable slots xor'ed into one."""
        n, out = self.spec.syllable_bits, 0
        for i in range(0, len(bits), n):
            out ^= int(bits[i : i + n].ljust(n, "0"), 2)
        return format(out, f"0{n}b")


def word_bits(tokens: Column, spec: Spec, max_syllables: int = 6) -> Column:
    """``BitEncoder.word`` of a column of tokens, a batch at a time."""

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        encoder = BitEncoder(spec)
        return pd.Series([None if x is None else encoder.word(list(x), max_syllables) for x in t])

    return run(tokens)


def folded(bits: Column, width: int) -> Column:
    """All slots of ``width`` bits xor'ed into one; a last slot is filled with zeros."""
    places = F.sequence(F.lit(1), F.lit(width))
    slots = lambda i: F.sequence(i, F.greatest(F.char_length(bits), i), F.lit(width))
    return F.array_join(F.transform(places, lambda i: F.when(F.size(F.filter(slots(i), lambda at: F.substr(bits, at, F.lit(1)) == "1")) % 2 == 1, "1").otherwise("0")), "")


def hamming_distance(a: Column, b: Column) -> Column:
    """Differing places of two bit strings; an error if their lengths differ."""
    same = F.assert_true(F.char_length(a) == F.char_length(b), F.lit("bit vectors differ in length"))
    d = F.char_length(a) - F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda e: e))
    return F.when(same.isNull(), d)


def hamming_similarity(a: Column, b: Column) -> Column:
    return F.when(F.char_length(a) == 0, F.lit(1.0)).otherwise(1 - hamming_distance(a, b) / F.char_length(a))
