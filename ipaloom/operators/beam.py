"""Segmenting a phrase into words of another language by a bounded beam search.

Expansion and search of one phrase in one language are one group: candidates for
every consumed length come from the scan kernel, partial paths are kept by
score (cost for each consumed phoneme, then order of discovery), and whole paths
are scored again end to end. Candidate entries are gathered by phrase and
language after a lossless length bound, so a group holds what can occur in its
phrase, not the dictionary.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ipaloom.functions.distance import batch_edit, pad
from ipaloom.functions.features import distance_matrix
from ipaloom.operators.scan import Phrase
from ipaloom.session import ship


@dataclass(frozen=True)
class BeamConfig:
    beam_width: int = 10
    top_k: int = 5
    max_words: int = 4
    max_distance: float = 0.5
    prune_ratio: float = 2.0
    max_len_ratio: float = 3.0
    min_target_tokens: int = 1


@dataclass(frozen=True)
class Path:
    score: float
    consumed: int
    raw: float
    entries: tuple[int, ...]


def expand(source: np.ndarray, consumed: int, targets: np.ndarray, lengths: np.ndarray, matrix: np.ndarray, config: BeamConfig) -> list[tuple[int, float, int]]:
    """(length, cost, entry) of entries that may cover the phonemes from ``consumed`` on.

    An entry covers as many phonemes as it has; its cost is the distance to them,
    and cost / max(stretch, length) must stay within max_distance.
    """
    rest = len(source) - consumed
    out = []
    for n in np.unique(lengths):
        if n < max(1, config.min_target_tokens) or n > int(rest * config.max_len_ratio) + 1:
            continue
        chunk = source[consumed : consumed + n]
        longest = max(len(chunk), n)
        if n - len(chunk) > config.max_distance * longest + 1e-9:
            continue
        at = np.flatnonzero(lengths == n)
        cost = batch_edit(chunk, targets[at, :n], lengths[at], matrix)
        good = cost / longest <= config.max_distance + 1e-12
        out += [(int(n), float(c), int(e)) for c, e in zip(cost[good], at[good])]
    return sorted(out, key=lambda x: x[2])


def search(length: int, candidates, config: BeamConfig) -> list[Path]:
    """Complete paths by score. ``candidates(consumed)`` gives (length, cost, entry).

    The ceiling tightens as soon as a path completes, in order of visit.
    """
    beam, done = [Path(0.0, 0, 0.0, ())], []
    ceiling = config.max_distance * config.prune_ratio
    for depth in range(1, config.max_words + 1):
        longer: list[Path] = []
        for path in beam:
            for n, cost, entry in candidates(path.consumed):
                consumed, raw = min(length, path.consumed + n), path.raw + cost
                score = raw / consumed
                if score > ceiling:
                    continue
                new = Path(score, consumed, raw, (*path.entries, entry))
                if consumed == length:
                    done.append(new)
                    ceiling = min(ceiling, score * config.prune_ratio) if len(done) > 1 else score * config.prune_ratio
                elif depth < config.max_words:
                    longer.append(new)
        beam = sorted(longer, key=lambda p: p.score)[: config.beam_width]
        if not beam:
            break
    return sorted(done, key=lambda p: p.score)


def segment(source: list[str], entries: list[tuple[str, str, list[str]]], features: Mapping, config: BeamConfig) -> list[tuple[list[str], list[str], float, float]]:
    """(words, ipas, distance, segment cost) of the best segmentations of ``source`` by (word, ipa, tokens)."""
    if not source or not entries:
        return []
    index, matrix = distance_matrix(features, sorted({t for _, _, ts in entries for t in ts} | set(source)))
    ids = np.array([index[t] for t in source])
    targets, lengths = pad([[index[t] for t in ts] for _, _, ts in entries])
    memo: dict[int, list] = {}

    def candidates(consumed: int):
        if consumed not in memo:
            memo[consumed] = expand(ids, consumed, targets, lengths, matrix, config)
        return memo[consumed]

    paths, seen = [], set()
    for p in search(len(source), candidates, config)[: config.top_k * 3]:
        if p.entries not in seen:
            seen.add(p.entries)
            paths.append(p)
    if not paths:
        return []
    glued, n = pad([[x for e in p.entries for x in targets[e, : lengths[e]]] for p in paths])
    d = batch_edit(ids, glued, n, matrix) / np.maximum(n, len(ids))
    found, words_seen = [], set()
    for i in sorted(range(len(paths)), key=lambda i: d[i]):
        words = tuple(entries[e][0] for e in paths[i].entries)
        if d[i] <= config.max_distance and words not in words_seen:
            words_seen.add(words)
            found.append((list(words), [entries[e][1] for e in paths[i].entries], float(d[i]), paths[i].raw))
    return found[: config.top_k]


SCHEMA = "phrase string, lang string, words array<string>, ipas array<string>, glued_ipa string, distance double, segment_cost double"


def segment_phrases(phrases: Iterable[Phrase], entries: DataFrame, features: Mapping, config: BeamConfig = BeamConfig()) -> DataFrame:
    """Segmentations of every phrase by every language's dictionary (lang, word, ipa, tokens).

    A batch of the dictionary yields, for each phrase, the entries that fit some
    stretch of it; they meet by (phrase, lang) in order of word. Of equal token
    sequences all words stay.
    """
    phrases = [p for p in phrases if p.tokens]
    ship(entries.sparkSession)
    shared = entries.sparkSession.sparkContext.broadcast((phrases, dict(features), distance_matrix(features, sorted({t for p in phrases for t in p.tokens}))))
    loose = replace(config, beam_width=1)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, features, (index, matrix) = shared.value
        for batch in batches:
            tokens = batch.column(3).to_pylist()
            if unknown := {t for ts in tokens for t in ts} - index.keys():  # phonemes without features
                index, matrix = distance_matrix(features, [p for p in index if p not in features] + sorted(unknown))
            targets, lengths = pad([[index[t] for t in ts] for ts in tokens])
            for p in phrases:
                source = np.array([index[t] for t in p.tokens])
                at = sorted({e for c in range(len(source)) for _, _, e in expand(source, c, targets, lengths, matrix, loose)})
                take = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([p.key] * len(at), pa.string()), *take.columns], names=["phrase", "lang", "word", "ipa", "tokens"])

    fits = entries.select("lang", "word", "ipa", "tokens").mapInArrow(fit, "phrase string, lang string, word string, ipa string, tokens array<string>")

    def run(table: pa.Table) -> pa.Table:
        phrases, features, _ = shared.value
        key, lang = table.column("phrase")[0].as_py(), table.column("lang")[0].as_py()
        source = next(p for p in phrases if p.key == key)
        own = sorted(zip(table.column("word").to_pylist(), table.column("ipa").to_pylist(), table.column("tokens").to_pylist()))
        found = segment(list(source.tokens), own, features, config)
        columns = [[key] * len(found), [lang] * len(found), [f[0] for f in found], [f[1] for f in found], ["".join(f[1]) for f in found], [f[2] for f in found], [f[3] for f in found]]
        types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["phrase", "lang", "words", "ipas", "glued_ipa", "distance", "segment_cost"])

    return fits.groupBy("phrase", "lang").applyInArrow(run, SCHEMA)


def best(found: DataFrame, top_k: int = 1) -> DataFrame:
    """The ``top_k`` segmentations of each phrase and language."""
    order = Window.partitionBy("phrase", "lang").orderBy("distance", "segment_cost", F.array_join("words", " "))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).drop("rank")
