"""Toxicity by a convolutional text classifier over hashed word embeddings.

Words, lower-cased and stripped of outer punctuation (what has over 64
characters without white space, in pieces, see ``util.pieces``), hash to
embeddings: a word's is the sum of those of the word and of its beginnings of
PREFIXES letters, so that inflected words share what is learned. Filters of
widths 1, 2 and 3 run over the whole text and keep their maxima, and a logistic
layer gives a probability. All of it is trained in numpy, from random
embeddings, on a bounded labelled sample (``sample`` rows at most, see
``training``); most of the ids are left out at random while it learns, so that
beginnings learn as well as words, and the last half of the epochs is averaged.

CROSS networks each learn from all folds of the sample but one; the score is
that of their mean logit, held as one wider network. On the rows that may be
learned from (sf0.1, one fold of three learned and the other tested, both ways,
three seeds) one network over the whole sample found 135 of 152 toxic texts with
14 others, the mean of five 145 with 8, both with half of the ids left out. With
264 rows learned, 40 epochs and half left out the mean found 78 with 16 others;
with four fifths left out, smaller batches and 60 epochs 109 with 13. These rows
chose the constants below; no held-out row did.

The threshold is calibrated by language, as ``langid`` predicts it from the
text: a language model learned from the documents that may be learned from (lang
itself is never an input of a score). The best threshold of each language is
found on cross-fitted scores of the sample, and scores are bent so that it lies
at ``threshold`` for every language. Every language is calibrated, however few
its toxic texts: the sample's other texts count in with a weight of SHRINK toxic
texts in all, so that a language's threshold moves from the overall one as its
own texts add up. Texts without a predicted language have a group of their own.
Where no language can be learned, clusters of texts by their most frequent words
stand in.

Defined cases: null and empty texts get the score of a text without words; with
no labelled row, or labels of one kind only, every score is that share of label
1; repeated rows score alike; equal scores at the threshold are all predicted 1;
a null doc_id is kept and counts as not held out; very long texts are scored
whole, in pieces that overlap by the filter width; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ipaloom.llm import langid, util
from ipaloom.llm.textcnn import TextCNN, joined
from ipaloom.llm.training import labelled_sample

BUCKETS = 1 << 16
#: Labelled rows that are learned from at least, and folds of the scores that calibrate.
LEAST, CROSS = 10, 5
#: Embeddings of words and their beginnings, and the lengths of those.
FEATURES = 1 << 18
PREFIXES = (4, 5, 6)
FREQUENT = 128
#: Embedding width of all networks together, filter widths, filters of each in one network; rate of the embedding; shares of ids left out in training and of epochs that are averaged.
DIM, WIDTHS, FILTERS, RATE, DROP, AVERAGE = 8 * CROSS, (1, 2, 3), 6, 0.1, 0.8, 0.5
#: Texts that a network sees in all, and its epochs at least and at most.
SEEN, EPOCHS = 24_000, (6, 60)
#: Toxic texts that the whole sample counts as in a group's threshold.
SHRINK = 20
#: Starts of the clustering, of which the closest clusters are kept.
STARTS = 8
#: Words that a worker remembers; some 100 bytes each.
CACHE = 400_000
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


class _Words(dict):
    """Word -> row of ``parts``: its bucket, and the ids of its embeddings."""

    def __init__(self):
        self.parts = np.zeros((1024, 2 + len(PREFIXES)), np.int32)

    def clear(self) -> None:
        super().clear()
        self.__init__()

    def __missing__(self, word: str) -> int:
        if len(self) == len(self.parts):
            self.parts = np.concatenate([self.parts, np.zeros_like(self.parts)])
        plain = word.strip(_EDGE)
        row = len(self)
        if plain:
            features = [plain, *(plain[:n] + "*" if len(plain) > n else plain for n in PREFIXES)]
            self.parts[row] = [1 + xxhash.xxh32_intdigest(plain) % (BUCKETS - 1), *(1 + xxhash.xxh32_intdigest(f, 1) % (FEATURES - 1) for f in features)]
        self[word] = row
        return row


_words = _Words()


def parts(text: str | None) -> np.ndarray:
    """The words of a text in order, a row each: bucket and features."""
    if len(_words) > CACHE:
        _words.clear()
    rows = np.fromiter(map(_words.__getitem__, util.pieces((text or "").lower())), dtype=np.int64)
    got = _words.parts[rows]
    return got[got[:, 0] > 0]


_KEY = np.random.default_rng(31).integers(1, 1 << 62, 1 + len(PREFIXES), dtype=np.int64) * 2 + 1


def _logits(cnn: TextCNN, texts: list[np.ndarray]) -> np.ndarray:
    """Logits of texts given as rows of ``parts``; each distinct word is embedded once."""
    flat = np.concatenate([t[:, 1:] for t in texts])
    _, first, at = np.unique((flat * _KEY).sum(axis=1), return_index=True, return_inverse=True)
    e = np.concatenate([np.zeros((1, cnn.e.shape[1]), np.float32), cnn.e[flat[first]].sum(axis=1)])
    ends = np.cumsum([len(t) for t in texts])
    return cnn.over(e).logits(np.split(at + 1, ends[:-1])).astype(float)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    cnn: TextCNN | None
    prior: float
    lang: langid.Model | None
    frequent: np.ndarray
    groups: np.ndarray
    bends: np.ndarray

    def group(self, raw: list[str | None], texts: list[np.ndarray]) -> np.ndarray:
        """Number of each text's predicted language, or of its cluster."""
        if self.lang is not None:
            return self.lang.number(langid.counts(raw))
        return (profile([t[:, 0] for t in texts], self.frequent) @ self.groups.T).argmax(axis=1)

    def scores(self, raw: list[str | None]) -> np.ndarray:
        if self.cnn is None or not raw:
            return np.full(len(raw), self.prior)
        texts = [parts(t) for t in raw]
        return _sigmoid(_logits(self.cnn, texts)) ** self.bends[self.group(raw, texts)]


def profile(texts: list[np.ndarray], frequent: np.ndarray) -> np.ndarray:
    """Shares of the frequent words, scaled to length 1."""
    place = np.full(BUCKETS, -1)
    place[frequent] = np.arange(len(frequent))
    x = np.zeros((len(texts), len(frequent)), np.float32)
    for i, t in enumerate(texts):
        at = place[t]
        x[i] = np.bincount(at[at >= 0], minlength=len(frequent))
    x = np.sqrt(x)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _train(texts: list[np.ndarray], y: np.ndarray, seed: int) -> TextCNN:
    cnn = TextCNN(FEATURES, DIM // CROSS, WIDTHS, FILTERS, seed=seed)
    return cnn.fit([t[:, 1:] for t in texts], y, epochs=max(EPOCHS[0], min(EPOCHS[1], SEEN // len(y))), batch=16, sparse=RATE, drop=DROP, average=AVERAGE, clear=True)


def _best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """Middle of the stretch of thresholds with the largest F1 of the weighted texts."""
    if y.sum() < 3 or y.sum() == len(y):
        return 0.5
    weight = np.ones(len(y)) if weight is None else weight
    order = np.argsort(-p, kind="stable")
    w, toxic = weight[order], (weight * y)[order]
    f1 = 2 * np.cumsum(toxic) / (np.cumsum(w) + toxic.sum())
    best = int(f1.argmax())
    low = p[order[best + 1]] if best + 1 < len(y) else 0.0
    return float(np.clip((p[order[best]] + low) / 2, 0.1, 0.98))


def _thresholds(p: np.ndarray, y: np.ndarray, near: np.ndarray, groups: int) -> np.ndarray:
    """The threshold of each group, shrunk towards the overall one by the group's toxic texts."""
    return np.array([_best_threshold(p, y, (near == k) + SHRINK / max(1.0, float(y.sum()))) for k in range(groups)])


def _clusters(x: np.ndarray, groups: int) -> np.ndarray:
    """Centres of the closest of STARTS clusterings; starts are drawn by their distance from those before, so that small languages have one."""
    rng = np.random.default_rng(2)
    best, closest = np.zeros((1, x.shape[1]), x.dtype), -1.0
    known = x[x.any(axis=1)]
    for _ in range(STARTS if len(known) else 0):
        c = known[rng.integers(len(known))][None]
        while len(c) < groups:
            far = np.maximum(0, 1 - (known @ c.T).max(axis=1).astype(float))
            if far.sum() < 1e-3:
                break
            c = np.concatenate([c, known[rng.choice(len(known), p=far / far.sum())][None]])
        for _ in range(15):
            near = (known @ c.T).argmax(axis=1)
            c = np.stack([known[near == k].sum(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        if (close := float((known @ c.T).max(axis=1).sum())) > closest:
            best, closest = c, close
    return best


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = 5000, threshold: float = 0.7, groups: int = 6) -> Model:
    """Train on at most ``sample`` rows of labelled documents; their hashed words reach the driver.

    ``learn``, over doc_id, says which rows of ``labels`` and of ``docs`` may be
    learned from. ``groups``: clusters, where no language can be learned.
    """
    spark = docs.sparkSession
    util.ship(spark)
    lang = langid.fit(docs, learn) if "lang" in docs.columns else None
    lang = lang if lang is not None and lang.langs else None
    shared = spark.sparkContext.broadcast(lang)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = part.column(0).to_pylist()
                near = shared.value.number(langid.counts(raw)) if shared.value else np.zeros(len(raw), int)
                ids = pa.array([parts(t).astype(np.int32).ravel() for t in raw], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, part.column(1).cast(pa.int32()), pa.array(near.astype(np.int32))], names=["ids", "y", "near"])
        util.tidy(_words)

    rows = labelled_sample(docs, labels, "toxic", learn, sample).select("text", "y").mapInArrow(hashed, "ids array<int>, y int, near int").toArrow()
    ids = [i.values.to_numpy(zero_copy_only=False) for i in rows.column("ids")]
    y, near = (np.array(rows.column(c).to_pylist(), int) for c in ("y", "near"))
    # the order of arrival must not matter
    order = sorted(range(len(ids)), key=lambda i: (xxhash.xxh64_intdigest(ids[i].tobytes()), y[i], near[i]))
    texts = [ids[i].astype(np.int64).reshape(-1, 2 + len(PREFIXES)) for i in order]
    y, near = y[order].astype(np.float32), near[order]
    prior = float(y.mean()) if len(y) else 0.0
    if len(y) < LEAST or prior in (0.0, 1.0):
        return Model(None, prior, None, np.zeros(0, int), np.zeros((1, 0)), np.ones(1))
    frequent, c = np.zeros(0, int), np.zeros((1, 0))
    if lang is None:
        words = [t[:, 0] for t in texts]
        df = np.zeros(BUCKETS)
        for w in words:
            df[np.unique(w)] += 1
        frequent = np.sort(np.argsort(-df, kind="stable")[:FREQUENT])
        x = profile(words, frequent)
        c = _clusters(x, groups)
        near = (x @ c.T).argmax(axis=1)
    # scores for calibration come from networks that did not learn from a text
    fold = np.arange(len(y)) % CROSS
    p, nets = np.zeros(len(y)), []
    for k in range(CROSS):
        at, to = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        # a fold may hold all texts of a kind; then the whole sample is learned
        at = at if y[at].min() < y[at].max() else np.arange(len(y))
        nets.append(_train([texts[i] for i in at], y[at], 7 + k))
        p[to] = _sigmoid(_logits(nets[-1], [texts[i] for i in to]))
    bends = np.log(threshold) / np.log(_thresholds(p, y, near, len(lang.langs) + 1 if lang else len(c)))
    return Model(joined(nets), prior, lang, frequent, c, bends)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) for every row."""
    spark = docs.sparkSession
    util.ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                s = m.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])
        util.tidy(_words)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def held_out() -> Column:
    """Rows that are never learned from."""
    return F.coalesce(util.fold_of(3) == 1, F.lit(False))
