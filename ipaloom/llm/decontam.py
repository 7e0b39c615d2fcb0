"""Benchmark decontamination: short test items inside long documents.

Texts become sets of ``WORDS``-word shingles over lower-cased letters and digits
(fewer words: the whole sequence as one). A document holds an item if at least
``threshold`` of the item's shingles are among its own.

Items are partitioned by the size of their shingle set, into classes up to the
next power of two. An item's MinHash sketch holds its smallest hashes, as many as
its class needs: with m hashes in the sketch and at most e of an item's n shingles
missing from a document that holds it, at least m - e of the sketch are in the
document. A class's m is more than twice its e, so that the share of the sketch
that a document has, which estimates the containment, sorts out most chance hits
and loses nothing. Documents are probed only with the classes that they are large
enough for. What reaches its bound is a candidate pair, whose containment is then
counted exactly on the words themselves, over all shingles of the item and the
document.

The sketches are broadcast only if their number is under ``BROADCAST_ROWS``, the
items' words only if they have under ``BROADCAST_CHARS`` characters; beyond that
Spark joins by shuffle. So with the candidate documents.

Defined cases: null texts and texts without a word hold nothing and are held by
nothing; repeated items are one item (its smallest id is named first) but each
id is reported; repeated documents are reported once per doc_id and text; a null
doc_id is matched like any other; very long texts are probed whole; a
containment of just the threshold counts; empty tables give no rows; other
columns are ignored by ``search`` and kept, whatever they are called, by
``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ipaloom.llm import util
from ipaloom.llm.util import let

WORDS = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 500_000
BROADCAST_CHARS = 32_000_000


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(text: Column, k: int = WORDS, make=None) -> Column:
    """Distinct shingles of ``k`` words; ``make`` turns a shingle's words (columns) into its value."""
    make = make or (lambda *w: F.concat_ws(" ", *w))

    def over(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - k), lambda i: make(*[F.get(w, i + j) for j in range(k)]))
        few = F.array(make(F.concat_ws(" ", w)))
        return F.array_distinct(F.when(n >= k, many).when(n > 0, few).otherwise(F.filter(few, lambda _: F.lit(False))))

    return let(words(text), over)


def hashes(text: Column, k: int = WORDS) -> Column:
    """Distinct 64-bit hashes of the shingles."""

    def over(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        few = F.array(F.xxhash64(F.concat_ws(" ", w)))
        return F.when(n >= k, many).when(n > 0, few).otherwise(F.filter(few, lambda _: F.lit(False)))

    return let(words(text), over)


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _items(items: DataFrame, threshold: float) -> DataFrame:
    """(item, item_ids, shingles, n, need, sketch, hits): one row for each distinct set of shingles.

    ``need``: shingles that a document must have to hold it; ``hits``: how many
    of the sketch at least.
    """
    rows = items.where(F.col("text").isNotNull()).select("item_id", F.array_sort(shingles(F.col("text"))).alias("shingles")).where(F.size("shingles") > 0)
    rows = rows.groupBy("shingles").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")).withColumn("item", F.xxhash64("shingles")).withColumn("n", F.size("shingles"))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n"))))  # the size class: up to the next power of two
    m = F.least(2 * (F.floor((1 - threshold) * upper + 1e-9) + 1), F.col("n")).cast("int")
    need = F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int")
    # a shingle's value must be the one that documents have, whose hash goes over its words
    value = F.transform("shingles", lambda s: F.when(F.size(F.split(s, " ")) == WORDS, let(F.split(s, " "), lambda w: F.xxhash64(*[F.get(w, F.lit(j)) for j in range(WORDS)]))).otherwise(F.xxhash64(s)))
    return rows.withColumn("sketch", F.slice(F.array_sort(value), F.lit(1), m)).withColumn("need", need).withColumn("hits", F.size("sketch") - (F.col("n") - need))


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, item_id, n_shared, n_shingles, containment, estimate) of all held items."""
    items = util.materialize(_items(items, threshold))
    # the least number of shingles that a document needs for an item of the class
    least = F.min("need").over(Window.partitionBy(F.ceil(F.log2(F.col("n")))))
    probes = util.materialize(items.select("item", "n", "need", "sketch").withColumn("least", least).select("item", "least", F.explode("sketch").alias("hash")))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.array_join("shingles", " "))), F.lit(0)).alias("chars")).first()
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    exploded = rows.select("doc_id", "text_hash", hashes(F.col("text")).alias("all")).select("doc_id", "text_hash", F.size("all").alias("size"), F.explode("all").alias("hash"))
    probed = exploded.join(_small(probes, probes.count()), "hash").where(F.col("size") >= F.col("least"))
    # a sketch bounds the hashes of a pair
    pairs = probed.groupBy("doc_id", "text_hash", "item").agg(F.size(F.collect_set("hash")).alias("found"))
    held_by = _small(items.select("item", "hits", F.size("sketch").alias("m")), size["n"])
    pairs = util.materialize(pairs.join(held_by, "item").where("found >= hits").select("doc_id", "text_hash", "item", (F.col("found") / F.col("m")).alias("estimate")))
    n_pairs = pairs.count()
    grouped = pairs.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set(F.struct("item", "estimate")).alias("cand"))
    held = rows.join(_small(grouped, n_pairs), rows["doc_id"].eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    held = held.select("doc_id", "text_hash", shingles(F.col("text")).alias("own"), F.explode("cand").alias("c")).select("doc_id", "text_hash", "own", "c.*")
    words_of = items.select("item", "item_ids", "shingles", "n")
    held = held.join(F.broadcast(words_of) if size["chars"] <= BROADCAST_CHARS else words_of, "item")
    held = held.select("doc_id", "text_hash", "item_ids", F.size(F.array_intersect("shingles", "own")).alias("n_shared"), F.col("n").alias("n_shingles"), "estimate")
    held = held.where(F.col("n_shared") >= F.ceil(F.lit(threshold) * F.col("n_shingles") - 1e-9)).dropDuplicates(["doc_id", "text_hash", "item_ids"])
    return held.select("doc_id", "text_hash", F.explode("item_ids").alias("item_id"), F.col("n_shared").cast("long"), F.col("n_shingles").cast("long"), (F.col("n_shared") / F.col("n_shingles")).alias("containment"), "estimate")


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    id_, hash_ = util.fresh(docs, "_id"), util.fresh(docs, "_hash")
    found = util.materialize(search(docs, items, threshold).select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct())
    on = docs["doc_id"].eqNullSafe(found[id_]) & (F.xxhash64(docs["text"]) == found[hash_])
    return docs.join(_small(found, found.count()), on, "left_anti")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL
), ds AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d)
), bs AS (
  SELECT DISTINCT item_id, s FROM (
    SELECT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM b)
), bn AS (
  SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id
), hits AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM hits JOIN bn USING (item_id)
WHERE n_shared >= ceil(0.8 * n_shingles - 1e-9)
"""
