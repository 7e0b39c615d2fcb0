"""Dictionary near-match: phrases against whole dictionaries, with the best matches of each phrase and language.

Phrases are a stated query set; their tokens go to every task (their size is
checked, larger sets go in blocks). Each Arrow batch of the dictionary is
filtered by length ratio, by the lossless bound on length difference and by
shared phonemes, and the rest is compared with one phrase at a time by a
vectorised kernel. Batches keep their ``top_n`` for each phrase, so that the
final window sees few rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ipaloom.functions.distance import batch_edit, pad
from ipaloom.functions.features import distance_matrix
from ipaloom.session import ship

LENGTH_RATIO, OVERLAP = 2.0, 0.20
#: Phrases that are sent along at once.
BLOCK = 20_000
SCHEMA = "phrase string, lang string, word string, ipa string, distance double"


@dataclass(frozen=True)
class Phrase:
    key: str
    tokens: tuple[str, ...]


def scan_batch(phrases: list[Phrase], tokens: list[list[str]], index: Mapping[str, int], matrix: np.ndarray, max_distance: float, overlap: float = OVERLAP, ratio: float = LENGTH_RATIO) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(phrase's number, entries' numbers, distances) of the matches in one batch."""
    known = [[index[t] for t in ts] for ts in tokens]
    targets, lengths = pad(known)
    holds = np.zeros((len(tokens), len(index)), dtype=bool)
    if targets.size:
        rows = np.repeat(np.arange(len(tokens)), lengths)
        holds[rows, np.concatenate([k for k in known if k] or [[]]).astype(int)] = True
    kinds = holds.sum(axis=1)
    for p, phrase in enumerate(phrases):
        source = np.array([index[t] for t in phrase.tokens], dtype=np.int64)
        if not len(source):
            continue
        longer, shorter = np.maximum(lengths, len(source)), np.minimum(lengths, len(source))
        fits = (lengths > 0) & (longer <= ratio * shorter) & (longer - shorter <= max_distance * longer + 1e-9)
        own = np.unique(source)
        if overlap:
            fits &= holds[:, own].sum(axis=1) >= overlap * np.minimum(kinds, len(own)) - 1e-12
        at = np.flatnonzero(fits)
        if len(at):
            d = batch_edit(source, targets[at, : lengths[at].max()], lengths[at], matrix) / longer[at]
            good = d <= max_distance + 1e-12
            yield p, at[good], d[good]


def scan(phrases: Iterable[Phrase], entries: DataFrame, features: Mapping[str, Mapping], top_n: int = 10, max_distance: float = 0.5, overlap: float = OVERLAP) -> DataFrame:
    """(phrase, lang, word, ipa, distance): the ``top_n`` nearest entries of each phrase in each language.

    ``entries``: (lang, word, ipa, tokens). Ties go to the smaller word. ``features``
    must hold the phonemes of both sides; the source's own take precedence when merged.
    """
    phrases = [p for p in phrases if p.tokens]
    out = None
    for at in range(0, max(1, len(phrases)), BLOCK):
        part = _scan(phrases[at : at + BLOCK], entries, features, top_n, max_distance, overlap)
        out = part if out is None else out.union(part)
    best = Window.partitionBy("phrase", "lang").orderBy("distance", "word", "ipa")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_n).drop("rank")


def _scan(phrases: list[Phrase], entries: DataFrame, features: Mapping, top_n: int, max_distance: float, overlap: float) -> DataFrame:
    ship(entries.sparkSession)
    base = sorted({t for p in phrases for t in p.tokens})
    shared = entries.sparkSession.sparkContext.broadcast((phrases, dict(features), distance_matrix(features, base)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, features, (index, matrix) = shared.value
        for batch in batches:
            tokens = batch.column(3).to_pylist()
            langs = batch.column(0).to_pylist()
            if unknown := {t for ts in tokens for t in ts} - index.keys():  # phonemes without features
                index, matrix = distance_matrix(features, [p for p in index if p not in features] + sorted(unknown))
            rows, keys, ds = [], [], []
            words = batch.column(1).to_pylist()
            for p, at, d in scan_batch(phrases, tokens, index, matrix, max_distance, overlap):
                kept: dict[str, int] = {}
                d = np.round(d, 6)
                for i in sorted(range(len(at)), key=lambda i: (d[i], words[at[i]])):
                    lang = langs[at[i]]
                    if kept.setdefault(lang, 0) < top_n:
                        kept[lang] += 1
                        rows.append(at[i]), keys.append(phrases[p].key), ds.append(d[i])
            take = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), take.column(0), take.column(1), take.column(2), pa.array(ds, pa.float64())], names=["phrase", "lang", "word", "ipa", "distance"])

    return entries.select("lang", "word", "ipa", "tokens").mapInArrow(run, SCHEMA)


def merged_features(source: Mapping, target: Mapping) -> dict:
    """Features of both languages; the source's win."""
    return {**target, **source}
