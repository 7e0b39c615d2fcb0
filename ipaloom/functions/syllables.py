"""Syllables: sonority, maximal onsets, stress."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ipaloom.sources.inventory import universal_dict

VOWEL, GLIDE, LIQUID, NASAL, FRICATIVE, STOP = 6, 5, 4, 3, 2, 1
TYPE = "array<struct<onset:array<string>,nucleus:array<string>,coda:array<string>,stress:string>>"
Syllable = tuple[list[str], list[str], list[str]]


def sonority(phoneme: str, extra: Mapping[str, int] | None = None) -> int:
    """Rank by universal features; ``extra`` comes first. A phoneme without features ranks as a stop."""
    if extra and phoneme in extra:
        return extra[phoneme]
    f = universal_dict(phoneme)
    if f["syl"] == 1:
        return VOWEL
    if f["son"] == 1:
        if f["cons"] != 1:
            return LIQUID if f["cor"] == 1 else GLIDE
        return NASAL if f["nas"] == 1 else LIQUID
    return FRICATIVE if f["cont"] == 1 else STOP


def ranks(tokens: Column, phones: Iterable[str], extra: Mapping[str, int] | None = None) -> Column:
    """Array of ranks; phonemes outside ``phones`` get 0."""
    table = F.create_map(*[F.lit(x) for p in sorted(set(phones)) for x in (p, sonority(p, extra))])
    return F.transform(tokens, lambda t: F.coalesce(table[t], F.lit(0)))


def max_onset(tokens: Sequence[str], vowels, rank: Sequence[int], appendix: bool = True) -> list[Syllable]:
    """Nuclei are runs of vowels; of the consonants between two, the longest stretch of rising sonority begins the second.

    ``appendix``: a fricative before a stop may join the onset. Without a vowel all tokens are one onset.
    """
    if not tokens:
        return []
    starts = [i for i, t in enumerate(tokens) if t in vowels and (i == 0 or tokens[i - 1] not in vowels)]
    if not starts:
        return [(list(tokens), [], [])]
    ends = []
    for s in starts:
        e = s
        while e < len(tokens) and tokens[e] in vowels:
            e += 1
        ends.append(e)
    cuts = [0]
    for e, s in zip(ends, starts[1:]):
        cut = s - 1 if s - e > 1 else e
        while cut > e and s - e > 1 and rank[cut - 1] < rank[cut]:
            cut -= 1
        if appendix and s - e > 1 and cut > e and rank[cut - 1] == FRICATIVE and rank[cut] == STOP:
            cut -= 1
        cuts.append(cut)
    cuts.append(len(tokens))
    return [(list(tokens[c:s]), list(tokens[s:e]), list(tokens[e:d])) for c, s, e, d in zip(cuts, starts, ends, cuts[1:])]


def assign_stress(syllables: Sequence[Syllable], marks: Iterable[tuple[int, str]]) -> list[str | None]:
    """The kind of mark that falls into each syllable; primary wins, then the later mark."""
    out: list[str | None] = []
    at = 0
    for s in syllables:
        end = at + sum(map(len, s))
        kinds = [k for i, k in marks if at <= i < end]
        out.append("primary" if "primary" in kinds else kinds[-1] if kinds else None)
        at = end
    return out


def syllabify(tokens: Column, vowels: Iterable[str], marks: Column | None = None, extra: Mapping[str, int] | None = None, appendix: bool = True, strategy: Callable | None = None) -> Column:
    """Array of syllables (onset, nucleus, coda, stress). ``strategy``: another segmenter (tokens, vowels, ranks)."""
    vowels = frozenset(vowels)
    extra = dict(extra or {})
    known: dict[str, int] = {}

    def rank_of(t):
        if t not in known:
            known[t] = sonority(t, extra)
        return known[t]

    def one(ts, ms):
        ts = list(ts) if ts is not None else []
        rank = list(map(rank_of, ts))
        found = strategy(ts, vowels, rank) if strategy else max_onset(ts, vowels, rank, appendix)
        stress = assign_stress(found, [(m["idx"], m["kind"]) for m in ms] if ms is not None else [])
        return [{"onset": o, "nucleus": n, "coda": c, "stress": s} for (o, n, c), s in zip(found, stress)]

    if marks is None:

        @F.pandas_udf(TYPE)
        def run(t: pd.Series) -> pd.Series:
            return pd.Series([one(x, None) for x in t])

        return run(tokens)

    @F.pandas_udf(TYPE)
    def run_marked(t: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(t, m)])

    return run_marked(tokens, marks)


def stress_pattern(syllables: Column) -> Column:
    """A digit for each syllable: 1 primary, 2 secondary, 0 none."""
    return F.array_join(F.transform(syllables, lambda s: F.when(s["stress"] == "primary", "1").when(s["stress"] == "secondary", "2").otherwise("0")), "")


def stressed_syllable(syllables: Column, kind: str = "primary") -> Column:
    return F.get(F.filter(syllables, lambda s: s["stress"] == kind), 0)


def syllable_count(syllables: Column) -> Column:
    return F.size(syllables)


def phonemes(syllable: Column) -> Column:
    return F.concat(syllable["onset"], syllable["nucleus"], syllable["coda"])


def rime(syllable: Column) -> Column:
    return F.concat(syllable["nucleus"], syllable["coda"])


def boundary_map(syllables: Column) -> Column:
    """For each token the number of its syllable."""
    return F.flatten(F.transform(syllables, lambda s, i: F.array_repeat(i, F.size(phonemes(s)))))
