"""Inversion: the nearest phonemes of another language."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ipaloom.functions.features import feature_distance


def invert(features: Mapping, target: Mapping[str, Mapping], top_n: int = 0, max_distance: float = 1.0) -> list[tuple[str, float]]:
    """Target phonemes by distance, in the target's order where equal; ``top_n`` 0 means all."""
    found = sorted(((p, feature_distance(features, f)) for p, f in target.items()), key=lambda x: x[1])
    found = [x for x in found if x[1] <= max_distance]
    return found[:top_n] if top_n else found


def invert_ipa(tokens: DataFrame, source: Mapping[str, Mapping], target: Mapping[str, Mapping], top_n: int = 3, max_distance: float = 0.6) -> DataFrame:
    """(key, pos, token, matches) for (key, tokens): each distinct token of the inventory is inverted once, on the driver."""
    table = [(p, [{"phoneme": q, "distance": round(d, 6)} for q, d in invert(f, target, top_n, max_distance)]) for p, f in source.items()]
    small = tokens.sparkSession.createDataFrame(table, "token string, matches array<struct<phoneme:string,distance:double>>")
    rows = tokens.select("key", F.posexplode("tokens").alias("pos", "token"))
    return rows.join(F.broadcast(small), "token", "left").select("key", "pos", "token", "matches")
