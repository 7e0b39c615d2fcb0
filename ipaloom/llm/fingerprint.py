"""Document fingerprints from closed syncmers over words, matched by position.

Words are what stands between white space; a run of over LONG characters without
any (prose in a script without spaces, say) is read character by character. An
anchor is a run of K words whose smallest pair of neighbouring words (by hash) is
its first or its last pair. Whether a run is an anchor depends on the run alone,
so equal passages have equal anchors wherever they stand. A fingerprint is the
text's anchors in their order, as 31-bit hashes with the number of their first
word. Two anchors that follow each other match two of another fingerprint that
follow each other at the same distance; likeness is the share of such links in
common (Dice, a text's last anchor being a link as well).

``compare_edited`` also needs each document's successor by doc_id. Rows are dealt
into ranges of (doc_id, hash of the text) in one shuffle; the ranges' starts are
quantiles of a sample of these pairs, which alone reaches the driver (PER_RANGE a
range). The first document of each range goes to the range before as well, so
that ``lead`` sees it; no task sorts more than its range. A range has about
ROWS_A_RANGE rows up to MAX_RANGES ranges, and its share of the rows beyond.

Defined cases: a null text counts as empty, with an empty fingerprint; texts
with fewer than K words have one anchor, their words; a text of K words or more
without a closed syncmer (only K or K + 1 words can be) has one anchor, the run
with the smallest edge; texts without a word have none, and likeness to or of
such a text is 0, or 1 between equal texts; null ids come first in the order;
equal and null ids are ordered by the hash of their text, then the text, and may
lie in several ranges (rows repeated whole lie in one), so repeated rows are each
other's neighbours; in a table of one row that row follows itself; very long
texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ipaloom.llm.util import let

K = 5
LONG = 32
#: A run of LONG characters at most between white space, else a single character.
WORD = rf"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{{1,{LONG}}}+(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]"
ROWS_A_RANGE = 512
MAX_RANGES = 1 << 16
PER_RANGE = 16
_ANCHORS = "array<struct<h:int,at:int>>"


def anchors(text: Column) -> Column:
    """Closed syncmers of the text's words (hash, number of the first word), in order."""

    def over(w: Column) -> Column:
        return let(F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)), lambda g: pick(w, g))

    def pick(w: Column, g: Column) -> Column:
        at = lambda i, j: F.get(g, i + j)
        short = lambda *c: F.xxhash64(*c).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
        anchor = lambda i: F.struct(short(*[at(i, j) for j in range(0, K - 1)]).alias("h"), i.cast("int").alias("at"))
        edge = lambda i: F.least(at(i, 0), at(i, K - 2))
        runs = F.sequence(F.lit(0), F.size(g) - (K - 1))
        many = F.transform(F.filter(runs, lambda i: edge(i) <= F.least(*[at(i, j) for j in range(1, K - 2)])), anchor)
        # runs of 5 or 6 words may have no closed one; then the one with the smallest edge, so that equal texts agree
        smallest = F.array_min(F.transform(runs, lambda i: F.struct(edge(i).alias("edge"), anchor(i)["h"].alias("h"), i.cast("int").alias("at"))))
        sure = let(many, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.struct(smallest["h"].alias("h"), smallest["at"].alias("at")))))
        few = F.array(F.struct(short(F.concat_ws(" ", w)).alias("h"), F.lit(0).alias("at")))
        return F.when(F.size(w) >= K, sure).when(F.size(w) > 0, few).otherwise(F.array()).cast(_ANCHORS)

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), over)


def links(a: Column) -> Column:
    """Distinct hashes of each anchor, the distance to the next one, and that."""
    return F.array_distinct(F.transform(a, lambda x, i: F.xxhash64(x["h"], F.get(a, i + 1)["at"] - x["at"], F.get(a, i + 1)["h"])))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two sets of links; 0 if one is empty."""
    total = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def written(a: Column) -> Column:
    return F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", F.hex(x["h"].cast("long")), x["at"])))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    return docs.select("doc_id", written(anchors(F.coalesce("text", F.lit("")))).alias("fingerprint"))


def _key(doc_id: Column, hash_: Column) -> Column:
    """What rows are ordered by, without nulls."""
    return F.struct(doc_id.isNotNull().alias("some"), F.coalesce(doc_id, F.lit(0)).alias("id"), hash_.alias("hash"))


def _starts(rows: DataFrame) -> list[tuple]:
    """Sorted keys at which ranges of about ROWS_A_RANGE rows start, the smallest key first; empty without rows."""
    got = rows.agg(F.count("*").alias("n"), F.min("key").alias("low")).first()
    k = min(MAX_RANGES, -(-got["n"] // ROWS_A_RANGE))
    if k <= 1:
        return [tuple(got["low"])] if got["n"] else []
    every = max(1, got["n"] // (PER_RANGE * k))
    sample = sorted(tuple(r) for r in rows.where(F.pmod(F.xxhash64("key", F.lit(6)), F.lit(every)) == 0).select("key.*").toArrow().to_pandas().itertuples(index=False, name=None))
    return sorted({tuple(got["low"]), *(sample[i * len(sample) // k] for i in range(1, k) if sample)})


def _range_of(starts: list[tuple], key: Column) -> Column:
    """Number of the last start that is not beyond ``key``, by halving."""
    fields = [F.split(F.lit(",".join(str(int(s[i])) for s in starts)), ",").cast("array<long>") for i in range(3)]  # folded to literals
    start = lambda i: F.struct((F.get(fields[0], i) == 1).alias("some"), F.get(fields[1], i).alias("id"), F.get(fields[2], i).alias("hash"))
    steps = [1 << i for i in reversed(range((len(starts) - 1).bit_length()))]
    if not steps:
        return F.lit(0)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step < len(starts)) & (start(at + step) <= key), at + step).otherwise(at))


def _is_start(starts: list[tuple], key: Column, own: Column) -> Column:
    ids, hashes = (F.split(F.lit(",".join(str(int(s[i])) for s in starts)), ",").cast("array<long>") for i in (1, 2))
    return (F.get(ids, own) == key["id"]) & (F.get(hashes, own) == key["hash"])


def compare_edited(docs: DataFrame) -> DataFrame:
    """For every row: its fingerprint and that of its edited text, with their likeness, and the next document's likeness.

    The edited text is the text with its last floor(n/2) characters replaced by
    the first as many of the next document (or all it has).
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", _key(F.col("doc_id"), F.xxhash64("text")))
    starts = _starts(rows.select("key"))
    if starts:
        rows = rows.withColumn("own", _range_of(starts, F.col("key")))
        # a range's first documents also stand at the end of the range before, the first of all at the end of the last
        before = F.when(F.col("own") > 0, F.col("own") - 1).otherwise(F.lit(len(starts) - 1))
        copies = F.array(F.struct(F.col("own").alias("range"), F.lit(0).alias("extra")), F.struct(before.alias("range"), F.lit(1).alias("extra")))
        rows = rows.withColumn("c", F.explode(F.when(_is_start(starts, F.col("key"), F.col("own")), copies).otherwise(F.slice(copies, 1, 1))))
        rows = rows.select("doc_id", "text", "key", F.col("c.range").alias("range"), F.col("c.extra").alias("extra"))
    else:
        rows = rows.select("doc_id", "text", "key", F.lit(0).alias("range"), F.lit(0).alias("extra"))
    order = Window.partitionBy("range").orderBy("extra", "key", "text")
    rows = rows.withColumn("next", F.lead("text").over(order))
    rows = rows.withColumn("fp", anchors(F.col("text"))).withColumn("links", links(F.col("fp"))).withColumn("next_links", F.lead("links").over(order))
    rows = rows.where("extra = 0").withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next", F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    rows = rows.withColumn("edited_fp", F.when(F.col("edited") == F.col("text"), F.col("fp")).otherwise(anchors(F.col("edited"))))
    rows = rows.withColumn("edited_links", links(F.col("edited_fp")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("fp")).alias("fingerprint"),
        written(F.col("edited_fp")).alias("edited_fingerprint"),
        F.when(F.col("edited") == F.col("text"), F.lit(1.0)).otherwise(likeness(F.col("links"), F.col("edited_links"))).alias("near_edited"),
        F.when(F.col("next") == F.col("text"), F.lit(1.0)).otherwise(likeness(F.col("links"), F.col("next_links"))).alias("near_next"),
    )
