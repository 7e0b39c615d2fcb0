"""Feature-weighted edit distance: a Catalyst form for small inputs, a numpy kernel for scans."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_distance(a: Column, b: Column, matrix: Column, insert: float = 1.0, delete: float = 1.0) -> Column:
    """Weighted Levenshtein distance of two arrays of phoneme numbers; ``matrix`` is an array of rows of substitution costs.

    One fold over ``a`` carries a row of the table; an inner fold over ``b`` makes the next.
    """
    first = F.transform(F.sequence(F.lit(0), F.size(b)), lambda j: j.cast("double") * insert)

    def row(prev: Column, x: Column) -> Column:
        start = F.array(F.element_at(prev, 1) + delete)
        return F.when(F.size(b) == 0, start).otherwise(
            F.aggregate(
                F.transform(b, lambda y, j: F.struct(y.alias("y"), j.alias("j"))),
                start,
                lambda r, e: F.concat(r, F.array(F.least(F.get(prev, e["j"] + 1) + delete, F.element_at(r, -1) + insert, F.get(prev, e["j"]) + F.get(F.get(matrix, x), e["y"])))),
            )
        )

    return F.element_at(F.aggregate(a, first, row), -1)


def normalised(d: Column, a: Column, b: Column) -> Column:
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(d / longest)


def batch_edit(source: np.ndarray, targets: np.ndarray, lengths: np.ndarray, matrix: np.ndarray, insert: float = 1.0, delete: float = 1.0) -> np.ndarray:
    """Distances of one source to many targets (rows padded on the right), a column of the table at a time for all of them."""
    n, width = targets.shape
    prev = np.arange(len(source) + 1)[:, None] * delete * np.ones(n)
    out = np.where(lengths == 0, prev[-1], 0.0)
    cost = matrix[source]
    for j in range(width):
        now = np.empty_like(prev)
        now[0] = prev[0] + insert
        sub = cost[:, targets[:, j]]
        for i in range(1, len(source) + 1):
            now[i] = np.minimum(np.minimum(prev[i] + insert, now[i - 1] + delete), prev[i - 1] + sub[i - 1])
        prev = now
        out = np.where(lengths == j + 1, prev[-1], out)
    return out


def pad(sequences: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in sequences], dtype=np.int64)
    out = np.zeros((len(sequences), int(lengths.max(initial=0))), dtype=np.int64)
    for r, s in zip(out, sequences):
        r[: len(s)] = s
    return out, lengths


def edit(a: Sequence[str], b: Sequence[str], features, insert: float = 1.0, delete: float = 1.0) -> float:
    """Distance of two token sequences under a mapping of features."""
    from ipaloom.functions.features import distance_matrix

    index, matrix = distance_matrix({p: features[p] for p in features if p in a or p in b}, [*a, *b])
    targets, lengths = pad([[index[t] for t in b]])
    return float(batch_edit(np.array([index[t] for t in a], dtype=np.int64), targets, lengths, matrix, insert, delete)[0])


def normalised_edit(a: Sequence[str], b: Sequence[str], features, insert: float = 1.0, delete: float = 1.0) -> float:
    return edit(a, b, features, insert, delete) / max(len(a), len(b)) if a or b else 0.0
