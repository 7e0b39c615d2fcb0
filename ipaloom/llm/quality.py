"""Quality by nearest-neighbour voting over latent-semantic vectors.

Each text becomes hashed TF-IDF counts of its words (what has over 64 characters
without white space, in pieces, see ``util.pieces``), of the shapes of its words
(letter case, digits and symbols, runs collapsed) and of directly repeated
words; a truncated SVD of a bounded labelled sample maps them to a few latent
dimensions. The sample's vectors and labels (``sample`` rows at most, so under
1 MB; see ``training`` for all its bounds) are broadcast; every document takes exact cosines to all of them, one
matrix product a block, and its nearest vote with their similarity.

Defined cases: null and empty texts have no terms and score the share of label
1 in the sample; with no labelled row at all every score is 0.5; repeated rows
score alike; of equally near neighbours at the last place one votes; a score at
the threshold counts as 1; very long texts are counted whole, one text at a
time; an empty table gives no rows; a null doc_id is kept and counts as not held
out; other columns are ignored by ``score`` and kept by ``keep_good``. Labels,
lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ipaloom.llm import util
from ipaloom.llm.training import labelled_sample

WORDS, SHAPES = 3072, 1023
TERMS = WORDS + SHAPES + 1
REPEAT = TERMS - 1
CACHE = 100_000
_RUNS = re.compile(r"(.)\1+", re.S)


def _shape(word: str) -> str:
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return _RUNS.sub(r"\1", kinds)


class _Terms(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        plain = "".join(c for c in word.lower() if c.isalnum())
        value = (xxhash.xxh32_intdigest(plain) % WORDS) << 16 | (WORDS + xxhash.xxh32_intdigest(_shape(word)) % SHAPES)
        self[word] = value
        return value


_terms = _Terms()


def counts(text: str | None) -> np.ndarray:
    """Term counts of one text."""
    ids = np.fromiter(map(_terms.__getitem__, util.pieces(text or "")), dtype=np.int64)
    out = np.bincount(np.concatenate([ids >> 16, ids & 0xFFFF]), minlength=TERMS).astype(np.float32)
    out[REPEAT] = np.count_nonzero(ids[1:] == ids[:-1])
    return out


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    k: int

    def weigh(self, x: np.ndarray) -> np.ndarray:
        """TF-IDF: words and shapes each scaled to length 1."""
        x = np.log1p(x) * self.idf
        for part, share in ((slice(0, WORDS), 0.4), (slice(WORDS, TERMS), 1.0)):
            x[:, part] *= share / np.maximum(np.linalg.norm(x[:, part], axis=1, keepdims=True), 1e-9)
        return x

    def embed(self, x: np.ndarray) -> np.ndarray:
        z = self.weigh(x) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        if not len(self.labels):
            return out
        known = np.flatnonzero(x.sum(axis=1) > 0)
        if len(known):
            s = self.embed(x[known]) @ self.vectors.T
            k = min(self.k, s.shape[1])
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(s, near, axis=1).astype(float), 0) ** 4
            votes = (w * self.labels[near]).sum(axis=1)
            total = w.sum(axis=1)
            out[known] = (votes + 1e-3 * self.prior) / (total + 1e-3)
        return np.clip(out, 0, 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, values, ys = [], [], []
        for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
            c = counts(text.as_py())
            at = np.flatnonzero(c)
            ids.append(at.astype(np.int32)), values.append(c[at]), ys.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), pa.array(ys, pa.int32())], names=["ids", "n", "y"])
    util.tidy(_terms)


def fit(docs: DataFrame, labels: DataFrame, learn, sample: int = 4000, dims: int = 32, k: int | None = None) -> Model:
    """Latent vectors of at most ``sample`` labelled documents; only their counted terms reach the driver.

    ``k`` neighbours vote, by default a quarter of the square root of the sample, 3 at least.
    """
    util.ship(docs.sparkSession)
    rows = labelled_sample(docs, labels, "quality", learn, sample).select("text", "y").mapInArrow(_counted, "ids array<int>, n array<float>, y int").toArrow().to_pylist()
    k = k or max(3, round(len(rows) ** 0.5 / 4))
    x, y = np.zeros((len(rows), TERMS), np.float32), np.array([r["y"] for r in rows], np.float32)
    # the order of arrival must not matter
    rows_order = sorted(range(len(rows)), key=lambda i: (y[i], rows[i]["ids"], rows[i]["n"]))
    y = y[rows_order]
    for i, j in enumerate(rows_order):
        x[i, rows[j]["ids"]] = rows[j]["n"]
    if not len(rows):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5, k)
    model = Model(np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1, np.zeros(0), np.zeros(0), y, float(y.mean()), k)
    weighed = model.weigh(x.copy())
    dims = min(dims, len(rows))
    q = np.random.default_rng(5).standard_normal((TERMS, dims + 8)).astype(np.float32)
    for _ in range(4):
        q, _r = np.linalg.qr(weighed.T @ (weighed @ q))
    _u, _s, vt = np.linalg.svd(weighed @ q, full_matrices=False)
    model.basis = (q @ vt[:dims].T).astype(np.float32)
    model.vectors = model.embed(x)
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row."""
    spark = docs.sparkSession
    util.ship(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts, out = batch.column(1), []
            for at in range(0, len(texts), 512):
                block = texts.slice(at, 512)
                x = np.zeros((len(block), TERMS), np.float32)
                for i, t in enumerate(block):
                    x[i] = counts(t.as_py())
                out.append(m.scores(x))
            s = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])
        util.tidy(_terms)

    return docs.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    spark = docs.sparkSession
    util.ship(spark)
    shared = spark.sparkContext.broadcast(model)
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                block = batch.slice(at, 512)
                x = np.stack([counts(t.as_py()) for t in block.column(at_text)])
                yield block.filter(pa.array(m.scores(x) >= threshold))
        util.tidy(_terms)

    return docs.mapInArrow(run, docs.schema)


def held_out():
    """Rows that are never learned from."""
    return F.coalesce(util.fold_of(5) == 0, F.lit(False))
