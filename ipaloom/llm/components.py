"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ipaloom.llm import util

#: Edges of a node from which it is a hub, and hubs whose minima are broadcast at most (16 MB).
HEAVY, HUBS = 1000, 500_000


def _with_minimum(edges: DataFrame, low: DataFrame) -> DataFrame:
    """``edges`` (u, v) with m, the minimum that ``low`` (u, m, c: the node's edges) has for u.

    Hubs' minima are broadcast, so that their edges stay where they are; the
    other nodes have under HEAVY edges each, which meet by shuffle.
    """
    hubs = low.where(F.col("c") >= HEAVY).select("u", "m")
    n = hubs.count()
    low = low.select("u", "m")
    if not 0 < n <= HUBS:  # none, or so many that none stands out; both sides are plain tables, which Spark can split
        return edges.join(low, "u")
    marked = edges.join(F.broadcast(hubs), "u", "left")
    return marked.where("m is not null").unionByName(marked.where("m is null").select("u", "v").join(low, "u"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = util.materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c")))
    return _with_minimum(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = util.materialize(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")))
    joined = _with_minimum(down, low)
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (u, v longs).

    Each round's edges are written to the shared folder; ends when they are
    stars: every node points to one other, which points nowhere. The number of
    rounds grows with the logarithm of a path's length. Minima are
    pre-aggregated, and a hub's edges are not gathered anywhere.
    """
    edges = util.materialize(edges.where("u != v").select("u", "v"))
    for _ in range(rounds):
        large = util.materialize(_large_star(edges))
        small = util.materialize(_small_star(large))
        util.drop(edges, large)
        edges = small
        ends = edges.groupBy(F.col("u").alias("n")).agg(F.count("*").alias("c")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("c")).distinct())
        if ends.groupBy("n").agg(F.sum("c").alias("out"), F.count("*").alias("roles")).where("out > 1 or roles > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"no stars after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
