"""Near-duplicate groups by SetSketch (Ertl, 2021), confirmed on whole shingle sets.

A text is a set of ``k``-word shingles. Its sketch holds REGISTERS registers, each
the truncated, exponentially spaced minimum of the set under one hash function:
mergeable, and two sets' registers agree about as often as the sets do.

1. Every row gets its set's 64-bit digest (its node) and the hashes of BANDS
   bands of registers, in one pass over the texts, written to the shared folder.
   Equal sets share a node from here on, so exact copies cost one row each.
2. Nodes that share a band's value form a bucket and are tied to its smallest
   node (minimum and count are pre-aggregated; no pairs are made).
3. Stars: every node is compared with the smallest node that it is tied to, one
   comparison a node. A hub's partners are dealt in blocks, each with a copy of
   the hub's text. The confirmed links' components settle all buckets whose
   nodes then lie in one component.
4. What shares a bucket with a node of another component is compared further:
   such buckets' connected clusters go to tasks, small ones several to a task,
   large ones cut into blocks, one task for two blocks. Pairs inside one
   component are not compared, nor blocks of the component that dominates a
   cluster with each other.
5. Components of all confirmed links are the groups.

Inside a task, pairs are screened by the joint maximum-likelihood estimate from
the two sketches and the set sizes; those that may reach the threshold are
confirmed by exact intersection, through an inverted index of the block. Tasks
return spanning links only.

With 30 bands of 5 registers two sets at similarity 0.8 miss all buckets with
probability 7e-6, less the more alike they are. Nothing is capped or sampled.
Step 4's comparisons grow with the square of a cluster's distinct sets outside
its dominant component: of sets that share a bucket but are not alike enough.

Defined cases: null texts and texts without words have an empty set, are linked
with nothing and stay; texts with fewer than ``k`` words have one shingle, their
words; rows with the same doc_id are separate documents; null ids take part but
never name a group; very long texts are cut into shingles whole; the smallest
doc_id, then text hash, stays of a group; an empty table gives no rows; other
columns are ignored by ``groups`` and kept by ``dedup``. Distinct sets are told apart by a 64-bit
digest of all shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ipaloom.llm import util
from ipaloom.llm.components import components

BANDS, ROWS = 30, 5
REGISTERS = BANDS * ROWS
#: SetSketch's base, rate and limit.
BASE, RATE, LIMIT = 1.001, 20.0, 65534
#: Shingles in one block of a task.
BLOCK = 100_000
#: Rows of (id, hashes) that are broadcast at most, about 30 MB.
BROADCAST_ROWS = 500_000
CACHE = 100_000
#: Pairs whose estimate is below threshold - SLACK (over four standard errors) are dropped.
SLACK = 0.17

_rng = np.random.default_rng(20211)
_MUL = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) < 64:
            self[word] = h
        return h


_hashes = _Hashes()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of ``k`` words (bytes lower-case A-Z only and split at ASCII space)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    width = min(k, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        out = _mix(out + h[j : len(h) - width + 1 + j])
    return np.unique(out)


def registers(s: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 512):
        np.minimum(low, (s[at : at + 512, None] * _MUL + _ADD).min(axis=0), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)) + 20_000, 0, LIMIT + 1).astype(np.uint16)


def bands(r: np.ndarray) -> np.ndarray:
    """Hashes of the bands of rows of registers, as longs."""
    h = (r.reshape(-1, BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=2, dtype=np.uint64) + _SALT
    return _mix(h).view(np.int64)


def estimate(equal: np.ndarray, more: np.ndarray, n: int, others: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood similarity of a set of ``n`` and ``others`` from counts of equal and larger registers."""
    u, v = n / (n + others), others / (n + others)
    grid = np.linspace(0.3, 1.0, 71)[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * grid), p(v - u * grid)
    fits = more * np.log(up) + (REGISTERS - equal - more) * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1))
    fits = np.where(grid <= np.minimum(u / v, v / u) + 1e-9, fits, -np.inf)
    return grid[fits.argmax(axis=0), 0]


class _Union:
    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links among ``sets``, pairs of a ``left`` and a ``right`` set (masks) compared; those of one ``group`` (numbers) are linked already."""
    n = np.array([len(s) for s in sets])
    regs = np.stack([registers(s) for s in sets])
    at_right = np.flatnonzero(right)
    flat = np.concatenate([sets[i] for i in at_right])
    owner = np.repeat(np.arange(len(at_right)), n[at_right])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    union, n_right, r_right = _Union(len(sets)), n[at_right], regs[at_right]
    group = np.arange(len(sets)) if group is None else group.copy()
    for a in np.flatnonzero(left):
        fits = (100 * np.minimum(n[a], n_right) >= percent * np.maximum(n[a], n_right)) & (group[at_right] != group[a])
        if not fits.any():
            continue
        equal = (r_right == regs[a]).sum(axis=1)
        at = np.flatnonzero(fits & (equal >= (percent / 100 - SLACK - 0.1) * REGISTERS))
        if not len(at):
            continue
        at = at[estimate(equal[at], (regs[a] > r_right[at]).sum(axis=1), n[a], n_right[at]) >= percent / 100 - SLACK]
        if not len(at):
            continue
        lo, hi = np.searchsorted(flat, sets[a], "left"), np.searchsorted(flat, sets[a], "right")
        shared = np.bincount(np.concatenate([owner[x:y] for x, y in zip(lo, hi)] or [[]]).astype(np.int64), minlength=len(at_right))[at]
        hits = at[100 * shared >= percent * (n[a] + n_right[at] - shared)]
        for b in at_right[hits]:
            union.join(a, int(b))
        if len(hits):
            merged = {int(group[b]) for b in at_right[hits]} | {int(group[a])}
            group[np.isin(group, list(merged))] = min(merged)
    return [(i, union.find(i)) for i in range(len(sets)) if union.find(i) != i]


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_hash, node, n, bands) of every row; node and bands are null for empty sets."""
    util.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                nodes, sizes, regs = [], [], []
                for t in part.column(2):
                    s = shingle_set(t.as_py(), k)
                    sizes.append(len(s))
                    nodes.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
                    if len(s):
                        regs.append(registers(s))
                got = iter(bands(np.stack(regs)) if regs else [])
                keys = [next(got) if n else None for n in sizes]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "node", "n", "bands"])
        util.tidy(_hashes)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, node long, n long, bands array<long>")


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _ties(nodes: DataFrame) -> DataFrame:
    """(key, c, low, node, n): every node of a bucket but its smallest, with that one; c: the bucket's nodes, n: the node's shingles."""
    keys = nodes.select("node", "n", F.explode("bands").alias("key"))
    buckets = util.materialize(keys.groupBy("key").agg(F.min("node").alias("low"), F.max(F.struct("node", "n")).alias("high"), F.count("*").alias("c")).where("c > 1"))
    pairs = buckets.where("c = 2").select("key", "c", "low", "high.node", "high.n")
    large = buckets.where("c > 2").select("key", "c", "low")
    rest = keys.join(_small(large, large.count()), "key").select("key", "c", "low", "node", "n")
    out = util.materialize(pairs.union(rest).where("low != node"))
    util.drop(buckets)
    return out


def _stars(ties: DataFrame) -> DataFrame:
    """Work rows (see ``_confirmed``) that compare every tied node with the smallest it is tied to."""
    pairs = util.materialize(ties.groupBy("node").agg(F.min("low").alias("cluster"), F.first("n").alias("n")))
    blocks = F.ceil(F.sum("n") / BLOCK).cast("int")
    hubs = util.materialize(pairs.groupBy("cluster").agg(F.sum("n").alias("total"), blocks.alias("blocks")))
    task = F.when(F.col("blocks") > 1, F.col("cluster")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(_pooled(hubs))))
    part = lambda c: F.when(F.col("blocks") > 1, c).otherwise(F.lit(-1))
    none = F.lit(None).cast("long")
    of_hub = hubs.select(task.alias("task"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), "*").select("task", part(F.col("b")).alias("i"), F.lit(-1).alias("j"), "cluster", F.col("cluster").alias("node"), F.lit(1).alias("side"), none.alias("label"))
    rest = pairs.join(_small(hubs.select("cluster", "blocks"), hubs.count()), "cluster")
    rest = rest.select(task.alias("task"), part(F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks")).cast("int")).alias("i"), F.lit(-1).alias("j"), "cluster", "node", F.lit(2).alias("side"), none.alias("label"))
    return of_hub.union(rest)


def _pooled(sizes: DataFrame) -> int:
    """Tasks for the clusters (total, blocks) of one block."""
    total = sizes.where("blocks = 1").agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    return 1 + int(total) // (BLOCK // 4)


def _unsettled(ties: DataFrame, labels: DataFrame) -> DataFrame:
    """(low, node): ties of the buckets that hold nodes of several components, less pairs that were compared."""
    n = labels.count()
    known = ties.join(_small(labels, n), "node", "left").withColumn("mine", F.coalesce("component", "node")).drop("component")
    known = known.join(_small(labels.select(F.col("node").alias("low"), "component"), n), "low", "left").withColumn("its", F.coalesce("component", "low"))
    first = ties.groupBy("node").agg(F.min("low").alias("first"))
    known = known.join(first, "node").withColumn("done", (F.col("c") == 2) & (F.col("low") == F.col("first")))
    open_ = known.groupBy("key").agg(F.min(F.least("mine", "its")).alias("a"), F.max(F.greatest("mine", "its")).alias("b"), F.max("done").alias("done")).where("a != b and not done").select("key")
    open_ = util.materialize(open_)
    return ties.join(_small(open_, open_.count()), "key").select("low", "node")


def _clusters(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Work rows (see ``_confirmed``) for the clusters that ``edges`` (low, node) connect."""
    clusters = components(edges.select(F.col("low").alias("u"), F.col("node").alias("v"))).withColumnRenamed("component", "cluster")
    members = nodes.select("node", "n").join(clusters, "node").join(_small(labels, labels.count()), "node", "left")
    members = util.materialize(members.select("node", "n", "cluster", F.coalesce("component", "node").alias("label")))
    parts = members.groupBy("cluster", "label").agg(F.sum("n").alias("n"))
    sizes = parts.groupBy("cluster").agg(F.sum("n").alias("total"), F.max(F.struct("n", "label")).alias("top"))
    first = F.ceil(F.col("top.n") / BLOCK)
    sizes = sizes.select("cluster", "total", F.col("top.label").alias("top"), F.when(F.col("total") <= BLOCK, 0).otherwise(first).cast("int").alias("own"), F.when(F.col("total") <= BLOCK, 1).otherwise(first + F.ceil((F.col("total") - F.col("top.n")) / BLOCK)).cast("int").alias("blocks"))
    sizes = util.materialize(sizes)
    rows = members.join(_small(sizes, sizes.count()), "cluster")
    spread = lambda n: F.pmod(F.xxhash64("node", F.lit(9)), n).cast("int")
    rows = rows.withColumn("b", F.when(F.col("blocks") == 1, 0).when(F.col("label") == F.col("top"), spread(F.col("own"))).otherwise(F.col("own") + spread(F.col("blocks") - F.col("own"))))
    # blocks of the dominant component meet the others only
    rows = rows.withColumn("o", F.explode(F.when(F.col("b") < F.col("own"), F.sequence("own", F.col("blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    one = F.col("blocks") == 1
    task = F.when(one, F.pmod(F.xxhash64("cluster"), F.lit(_pooled(sizes)))).otherwise(F.col("cluster"))
    side = F.when(F.col("b") == F.col("o"), 3).when(F.col("b") < F.col("o"), 1).otherwise(2)
    return rows.select(task.alias("task"), F.when(one, -1).otherwise(F.least("b", "o")).alias("i"), F.greatest("b", "o").alias("j"), "cluster", "node", side.alias("side"), "label")


def _confirmed(docs: DataFrame, nodes: DataFrame, work: DataFrame, k: int, percent: int, repeated: bool) -> DataFrame:
    """(u, v): spanning links that ``work`` finds.

    ``work``: (task, i, j, cluster, node, side, label); the nodes of one task, i
    and j are compared by cluster, those of side 1 or 3 with those of side 2 or
    3. A node's text is that of its smallest row.
    """
    work = util.materialize(work.join(nodes.select("node", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "node"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = rows.join(_small(work, work.count()), rows["doc_id"].eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    names = ["task", "i", "j", "cluster", "node", "side", "label"]
    rows = rows.select(*names, "text")
    if repeated:  # rows with one id and one text, of which a task needs one
        rows = rows.groupBy(*names).agg(F.first("text").alias("text"))

    def run(table: pa.Table) -> pa.Table:
        by: dict[int, dict[int, tuple]] = {}
        for c, node, side, label, text in zip(*(table.column(n).to_pylist() for n in ("cluster", "node", "side", "label")), table.column("text")):
            by.setdefault(c, {}).setdefault(node, (side, node if label is None else label, text))
        u, v = [], []
        for own in by.values():
            found = sorted(own)
            side = np.array([own[x][0] for x in found])
            _, group = np.unique([own[x][1] for x in found], return_inverse=True)
            left, right = side != 2, side != 1
            if len(found) > 1 and left.any() and right.any():
                for a, b in links([shingle_set(own[x][2].as_py(), k) for x in found], left, right, percent, group):
                    u.append(found[a]), v.append(found[b])
        util.tidy(_hashes)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    out = util.materialize(rows.groupBy("task", "i", "j").applyInArrow(run, "u long, v long"))
    util.drop(work)
    return out


def groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, keeper) of every row.

    Sets are linked if 100 * shared >= percent * union. ``component_id`` is the
    smallest doc_id of the group; ``keeper`` marks the group's smallest (doc_id,
    text_hash), and rows with an empty set.
    """
    texts = docs.select("doc_id", "text")
    rows = util.materialize(_signatures(texts, k))
    repeated = not rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    nodes = util.materialize(rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("doc_id", "text_hash", "n", "bands")).alias("r")).select("node", "r.*"))
    ties = _ties(nodes)
    near = _confirmed(texts, nodes, _stars(ties), k, percent, repeated)
    labels = util.materialize(components(near))
    edges = util.materialize(_unsettled(ties, labels))
    if not edges.isEmpty():
        more = _confirmed(texts, nodes, _clusters(nodes, edges, labels), k, percent, repeated)
        labels = util.materialize(components(near.union(more)))
        util.drop(more)
    util.drop(ties, edges, near, nodes)
    rows = rows.select("doc_id", "text_hash", "n", "node").join(_small(labels, labels.count()), "node", "left").withColumn("component", F.coalesce("component", "node"))
    many = rows.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"), F.count("*").alias("c"))
    many = util.materialize(many.where("c > 1").select("component", "low", F.col("first.doc_id").alias("keep_id"), F.col("first.text_hash").alias("keep_hash"), F.lit(True).alias("many")))
    rows = rows.join(_small(many, many.count()), "component", "left")
    keeper = F.col("many").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("text_hash").eqNullSafe(F.col("keep_hash")))
    return rows.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("many"), F.col("low")).otherwise(F.col("doc_id")).alias("component_id"), keeper.alias("keeper"))


def dedup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group; of rows with one doc_id and text any one."""
    found = util.materialize(groups(docs, k, percent))
    id_, hash_, mark = util.fresh(docs, "_id"), util.fresh(docs, "_hash"), util.fresh(docs, "_mark")
    named = [F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)]
    on = docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(hash_))
    out = found.where("not keeper").select(*named).distinct()
    kept = docs.join(_small(out, out.count()), on, "left_anti")
    # of keepers that are repeated whole one stays
    many = found.where("keeper and n_shingles > 0").groupBy("doc_id", "text_hash").agg(F.count("*").alias("c")).where("c > 1").select(*named, F.lit(True).alias(mark))
    many = util.materialize(many)
    if not many.isEmpty():
        kept = kept.join(_small(many, many.count()), on, "left")
        one = kept.where(F.col(mark)).dropDuplicates([id_, hash_])
        kept = kept.where(F.col(mark).isNull()).unionByName(one).select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]) WHEN len(w) = 1 THEN [w[1]] ELSE [] END) AS s FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)
), edges AS (
  SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links
), reach(u, v) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT reach.u, edges.v FROM reach JOIN edges ON reach.v = edges.u
), c AS (
  SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
