"""Language identification by nearest centroid.

A text's letters, lower-cased, give hashed character trigrams, weighted by
TF-IDF and scaled to length 1. Each language has several centroids, found by
spherical k-means over a bounded sample of its texts; a text takes the language
of the centroid with the largest cosine. The score is the softmax share of that
language; ``rejected`` marks texts farther from all centroids than nearly all
learned texts are from theirs (the language is still given).

Defined cases: null texts and texts without a letter are ``und`` with score 0;
with no learned language every text is ``und``; ties go to the first language
in alphabetical order; rows with a null lang are predicted but not learned
from; a null doc_id counts as not held out; repeated rows are predicted alike
and learned from once; very long texts are counted whole (in pieces that carry
their last two letters on), but texts over ``training.LONGEST`` characters are
not learned from; an empty table gives no rows; other columns are ignored. More
than MAX_LANGS languages are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ipaloom.llm import util
from ipaloom.llm.training import LONGEST

BUCKETS = 4096
#: Characters that are counted at once; longer texts go in pieces.
STEP = 1 << 20
#: Languages whose centroids are broadcast at most, 128 MB.
MAX_LANGS = 2000
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def _codes(text: str) -> Iterator[np.ndarray]:
    """Code points of the letters, every other run as one space, with a space at either end; in pieces that begin with the two codes before."""
    text = text.lower()
    last = np.array([32], np.uint32)
    for at in range(0, len(text), STEP):
        c = np.frombuffer(text[at : at + STEP].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        c = np.concatenate([last, np.where(_letter_table()[c], c, 32), [32] if at + STEP >= len(text) else []]).astype(np.uint64)
        gap = c == 32
        c = c[~(gap & np.concatenate([[False], gap[:-1]]))]
        yield c
        last = c[-2:]


def counts(texts: list[str | None]) -> np.ndarray:
    """Trigram counts, a row for each text; all zero without a letter."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    group: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush():
        nonlocal size
        if size > 2:
            codes = [c for _, c in group]
            lengths = np.array([len(c) for c in codes])
            flat = np.concatenate(codes)
            row = np.repeat(np.arange(len(codes)), lengths)
            h = flat[:-2] * np.uint64(0x9E3779B97F4A7C15) + flat[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + flat[2:] * np.uint64(0x165667B19E3779F9)
            h ^= h >> np.uint64(31)
            h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
            own = row[:-2] == row[2:]
            got = np.bincount(row[:-2][own] * BUCKETS + h[own].astype(np.int64), minlength=len(codes) * BUCKETS).reshape(len(codes), BUCKETS)
            np.add.at(out, np.array([r for r, _ in group]), got.astype(np.float32))
        group.clear()
        size = 0

    for r, t in enumerate(texts):
        for codes in _codes(t or ""):
            group.append((r, codes))
            size += len(codes)
            if size >= STEP or len(group) >= 256:
                flush()
    flush()
    return out


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    langs: list[str]
    limits: np.ndarray
    heat: float = 25.0

    def weigh(self, x: np.ndarray) -> np.ndarray:
        x = np.log1p(x) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def number(self, x: np.ndarray) -> np.ndarray:
        """Place of each row's language in ``langs``, their number for ``und``."""
        place = {lang: i for i, lang in enumerate(self.langs)} | {"und": len(self.langs)}
        return np.array([place[p] for p in self.predict(x)[0]], int)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        known = x.sum(axis=1) > 0
        if not self.langs:
            return ["und"] * len(x), np.zeros(len(x)), known
        cos = self.weigh(x) @ self.centroids.T
        best = np.stack([cos[:, self.owner == i].max(axis=1) for i in range(len(self.langs))], axis=1)
        top = best.argmax(axis=1)
        p = np.exp(self.heat * (best - best.max(axis=1, keepdims=True)))
        score = np.where(known, 1 / p.sum(axis=1), 0.0)
        rejected = known & (best.max(axis=1) < self.limits[top])
        return [self.langs[t] if k else "und" for t, k in zip(top, known)], score, rejected


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for at in range(0, len(texts), 256):
            x = counts(texts[at : at + 256])
            ids = [np.flatnonzero(r).astype(np.int32) for r in x]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array([r[i] for r, i in zip(x, ids)], pa.list_(pa.float32())), batch.column(1).slice(at, 256)], names=["ids", "n", "lang"])


def sample(docs: DataFrame, learn: Column, per_lang: int) -> DataFrame:
    """(text, lang) of at most ``per_lang`` different texts of each language, those with the smallest hash."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.char_length("text") <= LONGEST) & learn).select("text", "lang", F.xxhash64("text").alias("_h"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("_h").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    if not sizes:
        return known.select("text", "lang").limit(0)
    # somewhat more than is needed, then the smallest hashes; a copied text counts once before it is ranked
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1 << 30, (3 * per_lang << 29) // max(n, 1)))])
    rows = known.where(F.pmod("_h", F.lit(1 << 30)) < share[F.col("lang")]).dropDuplicates(["lang", "text"])
    order = Window.partitionBy("lang").orderBy(F.pmod("_h", F.lit(1 << 30)), "text")
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_lang).select("text", "lang")


def fit(docs: DataFrame, learn: Column, per_lang: int = 600, clusters: int = 4) -> Model:
    """Centroids from at most ``per_lang`` texts of each language; their counted trigrams reach the driver."""
    util.ship(docs.sparkSession)
    rows = sample(docs, learn, per_lang).mapInArrow(_counted, "ids array<int>, n array<float>, lang string").toArrow().to_pylist()
    rows = sorted((r for r in rows if r["ids"]), key=lambda r: (r["lang"], r["ids"], r["n"]))
    langs = sorted({r["lang"] for r in rows})
    df = np.zeros(BUCKETS)
    for r in rows:
        df[r["ids"]] += 1
    model = Model(np.log((1 + len(rows)) / (1 + df)).astype(np.float32) + 1, np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), langs, np.zeros(len(langs)))
    centroids, owner = [], []
    for i, lang in enumerate(langs):
        own = [r for r in rows if r["lang"] == lang]
        x = np.zeros((len(own), BUCKETS), np.float32)
        for j, r in enumerate(own):
            x[j, r["ids"]] = r["n"]
        x = model.weigh(x)
        rng = np.random.default_rng(11)
        c = x[rng.permutation(len(x))[: min(clusters, len(x))]]
        for _ in range(12):
            near = (x @ c.T).argmax(axis=1)
            c = np.stack([x[near == k].sum(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        centroids.append(c)
        owner += [i] * len(c)
        model.limits[i] = np.quantile((x @ c.T).max(axis=1), 0.005)
    if langs:
        model.centroids, model.owner = np.concatenate(centroids), np.array(owner)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row."""
    spark = docs.sparkSession
    util.ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lang, s, far = m.predict(counts(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(s, pa.float64()), pa.array(far, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])
        util.tidy()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out() -> Column:
    """Rows that are never learned from."""
    return F.coalesce(util.fold_of(3) == 1, F.lit(False))
