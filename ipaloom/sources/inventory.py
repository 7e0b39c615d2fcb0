"""Phoneme inventories: articulatory descriptions, from which features of both kinds follow by rule.

A language's own features are a sparse mapping (an absent feature is not a false
one); universal features are 24 ternary values.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Names and order of the universal features (fixed values).
UNIVERSAL = (
    "syl", "son", "cons", "cont", "delrel", "lat", "nas", "strid", "voi", "sg", "cg", "ant",
    "cor", "distr", "lab", "hi", "lo", "back", "round", "velaric", "tense", "long", "hitone", "hireg",
)

#: phoneme: place, manner, voiced
CONSONANTS = {
    "p": ("bilabial", "plosive", False), "b": ("bilabial", "plosive", True), "t": ("alveolar", "plosive", False), "d": ("alveolar", "plosive", True),
    "k": ("velar", "plosive", False), "ɡ": ("velar", "plosive", True), "ʔ": ("glottal", "plosive", False),
    "f": ("labiodental", "fricative", False), "v": ("labiodental", "fricative", True), "β": ("bilabial", "fricative", True), "θ": ("dental", "fricative", False), "ð": ("dental", "fricative", True),
    "s": ("alveolar", "fricative", False), "z": ("alveolar", "fricative", True), "ʃ": ("postalveolar", "fricative", False), "ʒ": ("postalveolar", "fricative", True),
    "ç": ("palatal", "fricative", False), "x": ("velar", "fricative", False), "ɣ": ("velar", "fricative", True), "h": ("glottal", "fricative", False),
    "ts": ("alveolar", "affricate", False), "tʃ": ("postalveolar", "affricate", False), "dʒ": ("postalveolar", "affricate", True), "pf": ("labiodental", "affricate", False),
    "m": ("bilabial", "nasal", True), "n": ("alveolar", "nasal", True), "ɲ": ("palatal", "nasal", True), "ŋ": ("velar", "nasal", True),
    "l": ("alveolar", "lateral", True), "ʎ": ("palatal", "lateral", True), "r": ("alveolar", "trill", True), "ɾ": ("alveolar", "tap", True), "ɹ": ("alveolar", "approximant", True), "ʁ": ("uvular", "fricative", True),
    "j": ("palatal", "glide", True), "w": ("velar", "glide", True), "ɥ": ("palatal", "glide", True),
}
#: phoneme: height, backness, rounded, tense
VOWELS = {
    "i": ("high", "front", False, True), "ɪ": ("high", "front", False, False), "y": ("high", "front", True, True), "ʏ": ("high", "front", True, False), "u": ("high", "back", True, True), "ʊ": ("high", "back", True, False),
    "e": ("mid", "front", False, True), "ɛ": ("mid", "front", False, False), "ø": ("mid", "front", True, True), "œ": ("mid", "front", True, False), "ə": ("mid", "central", False, False), "ɜ": ("mid", "central", False, True),
    "o": ("mid", "back", True, True), "ɔ": ("mid", "back", True, False), "ʌ": ("mid", "back", False, False),
    "æ": ("low", "front", False, False), "a": ("low", "front", False, True), "ɑ": ("low", "back", False, True), "ɒ": ("low", "back", True, False),
}
NASAL_VOWELS = {"ɛ̃": "ɛ", "ɔ̃": "ɔ", "ɑ̃": "ɑ", "œ̃": "œ"}

#: Phonemes of each language, and its spelling rules, longest first where they compete.
LANGUAGES = {
    "en": ("p b t d k ɡ f v θ ð s z ʃ ʒ h tʃ dʒ m n ŋ l ɹ j w i ɪ u ʊ ɛ ə ɜ ɔ ʌ æ ɑ", {
        "tion": "ʃən", "igh": "ɑɪ", "tch": "tʃ", "th": "θ", "sh": "ʃ", "ch": "tʃ", "ng": "ŋ", "ph": "f", "wh": "w", "ck": "k", "qu": "kw", "ou": "ɑʊ", "ow": "ɔʊ", "ea": "i", "ee": "i", "oo": "u", "ai": "ɛɪ", "er": "ɜ", "or": "ɔɹ",
        "a": "æ", "b": "b", "c": "k", "d": "d", "e": "ɛ", "f": "f", "g": "ɡ", "h": "h", "i": "ɪ", "j": "dʒ", "k": "k", "l": "l", "m": "m", "n": "n", "o": "ɑ", "p": "p", "r": "ɹ", "s": "s", "t": "t", "u": "ʌ", "v": "v", "w": "w", "x": "ks", "y": "j", "z": "z"}),
    "de": ("p b t d k ɡ ʔ f v s z ʃ ç x h ts tʃ pf m n ŋ l ʁ j i ɪ y ʏ u ʊ e ɛ ø œ ə o ɔ a", {
        "sch": "ʃ", "ch": "ç", "tz": "ts", "pf": "pf", "ng": "ŋ", "ei": "aɪ", "ie": "i", "eu": "ɔʏ", "au": "aʊ", "äu": "ɔʏ", "ck": "k", "qu": "kv",
        "a": "a", "ä": "ɛ", "b": "b", "c": "k", "d": "d", "e": "ə", "f": "f", "g": "ɡ", "h": "h", "i": "ɪ", "j": "j", "k": "k", "l": "l", "m": "m", "n": "n", "o": "o", "ö": "ø", "p": "p", "r": "ʁ", "s": "z", "ß": "s", "t": "t", "u": "ʊ", "ü": "y", "v": "f", "w": "v", "x": "ks", "y": "y", "z": "ts"}),
    "fr": ("p b t d k ɡ f v s z ʃ ʒ m n ɲ l ʁ j w ɥ i y u e ɛ ø œ ə o ɔ a ɛ̃ ɔ̃ ɑ̃ œ̃", {
        "eau": "o", "eux": "ø", "tion": "sjɔ̃", "ch": "ʃ", "gn": "ɲ", "ou": "u", "oi": "wa", "ai": "ɛ", "au": "o", "eu": "œ", "an": "ɑ̃", "en": "ɑ̃", "on": "ɔ̃", "in": "ɛ̃", "un": "œ̃", "qu": "k",
        "a": "a", "à": "a", "â": "a", "b": "b", "c": "k", "ç": "s", "d": "d", "e": "ə", "é": "e", "è": "ɛ", "ê": "ɛ", "ë": "ɛ", "f": "f", "g": "ɡ", "i": "i", "î": "i", "j": "ʒ", "k": "k", "l": "l", "m": "m", "n": "n", "o": "o", "ô": "o", "p": "p", "r": "ʁ", "s": "s", "t": "t", "u": "y", "û": "y", "ù": "y", "v": "v", "w": "w", "x": "ks", "y": "i", "z": "z"}),
    "es": ("p b t d k ɡ f β θ s x tʃ m n ɲ l ʎ r ɾ j w i u e o a", {
        "ch": "tʃ", "ll": "ʎ", "rr": "r", "qu": "k", "ci": "θi", "ce": "θe", "gu": "ɡ",
        "a": "a", "á": "a", "b": "b", "c": "k", "d": "d", "e": "e", "é": "e", "f": "f", "g": "ɡ", "i": "i", "í": "i", "j": "x", "k": "k", "l": "l", "m": "m", "n": "n", "ñ": "ɲ", "o": "o", "ó": "o", "p": "p", "r": "ɾ", "s": "s", "t": "t", "u": "u", "ú": "u", "ü": "w", "v": "β", "w": "w", "x": "ks", "y": "j", "z": "θ"}),
}



def _nfkd(x):
    """The same value with all strings decomposed, as cleaned transcriptions are."""
    if isinstance(x, str):
        return unicodedata.normalize("NFKD", x)
    if isinstance(x, dict):
        return {_nfkd(k): _nfkd(v) for k, v in x.items()}
    return tuple(map(_nfkd, x)) if isinstance(x, tuple) else x


CONSONANTS, VOWELS, NASAL_VOWELS = _nfkd(CONSONANTS), _nfkd(VOWELS), _nfkd(NASAL_VOWELS)
LANGUAGES = {k: (_nfkd(phones), {g: _nfkd(p) for g, p in rules.items()}) for k, (phones, rules) in LANGUAGES.items()}

CONSONANT_COLUMNS = (
    "voiced", "manner=plosive", "manner=fricative", "manner=affricate", "manner=nasal", "manner=lateral", "manner=trill", "manner=tap", "manner=approximant", "manner=glide",
    "place=bilabial", "place=labiodental", "place=dental", "place=alveolar", "place=postalveolar", "place=palatal", "place=velar", "place=uvular", "place=glottal",
)
VOWEL_COLUMNS = ("high", "mid", "low", "front", "central", "back", "round", "tense", "nasal")

_PLACE = {
    "bilabial": {"ant": 1, "cor": -1, "lab": 1}, "labiodental": {"ant": 1, "cor": -1, "lab": 1}, "dental": {"ant": 1, "cor": 1, "distr": 1}, "alveolar": {"ant": 1, "cor": 1, "distr": -1},
    "postalveolar": {"ant": -1, "cor": 1, "distr": 1}, "palatal": {"ant": -1, "cor": -1, "hi": 1, "back": -1}, "velar": {"ant": -1, "cor": -1, "hi": 1, "back": 1}, "uvular": {"ant": -1, "cor": -1, "hi": -1, "back": 1}, "glottal": {"ant": -1, "cor": -1},
}


def features(phoneme: str) -> dict[str, bool | str]:
    """A phoneme's own features; empty if it is unknown."""
    if phoneme in CONSONANTS:
        place, manner, voiced = CONSONANTS[phoneme]
        return {"voiced": voiced, "manner": manner, "place": place}
    base = NASAL_VOWELS.get(phoneme, phoneme)
    if base in VOWELS:
        height, backness, rounded, tense = VOWELS[base]
        return {height: True, backness: True, "round": rounded, "tense": tense} | ({"nasal": True} if base != phoneme else {})
    return {}


def _universal(phoneme: str) -> tuple[int, ...] | None:
    if phoneme in CONSONANTS:
        place, manner, voiced = CONSONANTS[phoneme]
        obstruent = manner in ("plosive", "fricative", "affricate")
        f = dict.fromkeys(UNIVERSAL, -1) | {"distr": 0, "tense": 0, "hitone": 0, "hireg": 0, "voi": 1 if voiced else -1}
        f |= {"son": -1 if obstruent else 1, "cons": -1 if manner in ("glide", "approximant") or place == "glottal" else 1}
        f |= {"cont": -1 if manner in ("plosive", "affricate", "nasal") else 1, "delrel": 1 if manner == "affricate" else -1 if manner == "plosive" else 0}
        f |= {"lat": 1 if manner == "lateral" else -1, "nas": 1 if manner == "nasal" else -1, "sg": 1 if phoneme == "h" else -1, "cg": 1 if phoneme == "ʔ" else -1}
        f |= {"strid": 1 if obstruent and manner != "plosive" and place in ("alveolar", "postalveolar", "labiodental") else -1}
        f |= _PLACE[place] | ({"round": 1, "lab": 1} if phoneme in ("w", "ɥ") else {})
        return tuple(f[n] for n in UNIVERSAL)
    base = NASAL_VOWELS.get(phoneme, phoneme)
    if base in VOWELS:
        height, backness, rounded, tense = VOWELS[base]
        f = dict.fromkeys(UNIVERSAL, -1) | {"syl": 1, "son": 1, "cont": 1, "voi": 1, "delrel": -1, "ant": 0, "distr": 0, "strid": 0, "hitone": 0, "hireg": 0}
        f |= {"hi": 1 if height == "high" else -1, "lo": 1 if height == "low" else -1, "back": 1 if backness == "back" else -1, "round": 1 if rounded else -1}
        f |= {"tense": 1 if tense else -1, "nas": 1 if base != phoneme else -1}
        return tuple(f[n] for n in UNIVERSAL)
    return None


@functools.lru_cache(maxsize=4096)
def universal(phoneme: str) -> tuple[int, ...]:
    """The 24 universal values: of the phoneme, else of its decomposed form, else without combining marks, else zeros."""
    decomposed = unicodedata.normalize("NFD", phoneme)
    bare = "".join(c for c in decomposed if not unicodedata.combining(c))
    for p in (phoneme, decomposed, bare, *([bare[:-1]] if bare.endswith(("ː", "ˑ")) else [])):
        if (found := _universal(p)) is not None:
            return found
    return (0,) * len(UNIVERSAL)


def sort_features(features: Mapping[str, bool | str]) -> dict[str, bool | str]:
    """The same features by name."""
    return dict(sorted(features.items()))


def phoneme_features(inventory: Mapping[str, Mapping], phoneme: str) -> Mapping[str, bool | str]:
    """A phoneme's features in an inventory; an error if it is not in it."""
    if phoneme not in inventory:
        raise KeyError(f"no phoneme {phoneme!r}")
    return inventory[phoneme]


def universal_dict(phoneme: str) -> dict[str, int]:
    return dict(zip(UNIVERSAL, universal(phoneme)))


def merge_inventories(*inventories) -> dict[str, dict[str, int]]:
    """Union of phonemes, each with its universal features."""
    return {p: universal_dict(p) for inventory in inventories for p in inventory}


@dataclass(frozen=True)
class Spec:
    """A language: its phonemes and the columns of its bit vectors."""

    key: str
    vowels: frozenset[str]
    features: Mapping[str, Mapping[str, bool | str]] = field(hash=False)
    consonant_columns: tuple[str, ...] = CONSONANT_COLUMNS
    vowel_columns: tuple[str, ...] = VOWEL_COLUMNS

    @property
    def phones(self) -> tuple[str, ...]:
        """Longest first, so that an alternation of them is greedy."""
        return tuple(sorted(self.features, key=lambda p: (-len(p), p)))

    @property
    def consonants(self) -> frozenset[str]:
        return frozenset(self.features) - self.vowels

    @property
    def syllable_bits(self) -> int:
        return 2 * len(self.consonant_columns) + len(self.vowel_columns)


def intersect(a: Spec, b: Spec) -> Spec:
    """Both languages' phonemes, with universal features and both languages' columns."""
    join = lambda x, y: tuple(dict.fromkeys([*x, *y]))
    return Spec(f"{a.key}+{b.key}", a.vowels | b.vowels, merge_inventories(a.features, b.features), join(a.consonant_columns, b.consonant_columns), join(a.vowel_columns, b.vowel_columns))


def derive_columns(inventory: Mapping[str, Mapping], vowels) -> dict[str, tuple[str, ...]]:
    """Feature names that occur with vowels, with modifiers (marker or modifier is true) and with consonants."""
    found: dict[str, set[str]] = {"vowel": set(), "modifier": set(), "consonant": set()}
    for p, f in inventory.items():
        kind = "vowel" if p in vowels else "modifier" if f.get("marker") or f.get("modifier") else "consonant"
        found[kind] |= set(f)
    return {k: tuple(sorted(v)) for k, v in found.items()}


class LanguageRegistry(Mapping):
    """Languages by key; further ones can be read from JSON in the documented layout."""

    def __init__(self, path: str | None = None):
        self._own = {}
        if path:
            with open(path, encoding="utf-8") as f:
                self._own = json.load(f)

    def __getitem__(self, key: str) -> Spec:
        key = key.replace("-", "_")
        if key in self._own:
            d = self._own[key]
            return Spec(key, frozenset(d["vowels"]), d["phonemes"], tuple(d["consonant_columns"]), tuple(d["vowel_columns"]))
        phones = LANGUAGES[key][0].split()
        return Spec(key, frozenset(p for p in phones if p in VOWELS or p in NASAL_VOWELS), {p: features(p) for p in phones})

    def __iter__(self) -> Iterator[str]:
        return iter([*LANGUAGES, *self._own])

    def __len__(self) -> int:
        return len(LANGUAGES) + len(self._own)

    def __contains__(self, key) -> bool:
        return isinstance(key, str) and (key.replace("-", "_") in self._own or key in LANGUAGES)

    def __repr__(self) -> str:
        return f"LanguageRegistry({', '.join(self)})"

    @functools.lru_cache(maxsize=256)  # noqa: B019
    def build_spec(self, key: str, reduce_features: bool = False) -> Spec:
        spec = self[key]
        if not reduce_features:
            return spec
        used = derive_columns(spec.features, spec.vowels)
        held = lambda c: any(f.get(c.split("=")[0]) == c.split("=")[-1] or f.get(c) for f in spec.features.values())
        return Spec(key, spec.vowels, spec.features, tuple(c for c in spec.consonant_columns if held(c)), tuple(c for c in spec.vowel_columns if c in used["vowel"] and held(c)))

    def build_distance(self, key: str, max_syllables: int = 6):
        """The ``Distance`` of a language."""
        from ipaloom.operators.pairs import Distance

        return Distance(self.build_spec(key), max_syllables)

    def clear_cache(self) -> None:
        """Forget the specifications that were built."""
        self.build_spec.cache_clear()

    def __hash__(self) -> int:
        return id(self)


def inventory_table(spark: SparkSession, langs=None) -> DataFrame:
    """(lang, phoneme, is_vowel, features): values are tagged by type, so that true and "true" differ."""
    tag = lambda v: f"b:{str(v).lower()}" if isinstance(v, bool) else f"s:{v}"
    reg = LanguageRegistry()
    rows = [(k, p, p in reg[k].vowels, {n: tag(v) for n, v in f.items()}) for k in langs or LANGUAGES for p, f in reg[k].features.items()]
    return spark.createDataFrame(rows, "lang string, phoneme string, is_vowel boolean, features map<string,string>")


def universal_table(spark: SparkSession) -> DataFrame:
    """(phoneme, vec): the universal features of all phonemes known here."""
    return spark.createDataFrame([(p, list(universal(p))) for p in [*CONSONANTS, *VOWELS, *NASAL_VOWELS]], "phoneme string, vec array<tinyint>")
