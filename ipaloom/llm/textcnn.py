"""A small convolutional text classifier in numpy: embedding, several filter widths, max pooling, logistic output.

Input is ragged: one flat array of ids and the start of each text. A token is an
id, or a row of ids whose embeddings add up (a word and its beginnings, say). As
the convolution is linear in each offset, scoring uses one table of products
(embedding x filter) per offset, so a filter costs a look-up and an addition.
"""

from __future__ import annotations

import copy

import numpy as np

PAD = 0


def flatten(texts: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat ids with ``pad`` padding ids after each text, each text's start, and which places begin a window of their text (an empty text has one)."""
    n = np.array([max(1, len(t)) for t in texts])
    starts = np.concatenate([[0], np.cumsum(n + pad)[:-1]]).astype(np.int64)
    flat = np.zeros((int((n + pad).sum()), *(texts[0].shape[1:] if len(texts) else ())), dtype=np.int64)
    for s, t in zip(starts, texts):
        flat[s : s + len(t)] = t
    inside = np.arange(len(flat)) - np.repeat(starts, n + pad) < np.repeat(n, n + pad)
    return flat, starts, inside


class TextCNN:
    def __init__(self, vocab: int, dim: int, widths: tuple[int, ...], filters: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.widths, self.filters = widths, filters
        self.e = (rng.standard_normal((vocab, dim)) * 0.1).astype(np.float32)
        self.e[PAD] = 0
        self.w = [(rng.standard_normal((k, dim, filters)) * (1.0 / np.sqrt(k * dim))).astype(np.float32) for k in widths]
        self.b = [np.zeros(filters, np.float32) for _ in widths]
        self.v = (rng.standard_normal(filters * len(widths)) * 0.1).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.tables: list[list[np.ndarray]] | None = None

    def __getstate__(self) -> dict:
        """Only embeddings that are not zero are sent along."""
        rows = np.flatnonzero(self.e.any(axis=1))
        return self.__dict__ | {"e": (self.e.shape, rows, self.e[rows])}

    def __setstate__(self, state: dict) -> None:
        shape, rows, e = state["e"]
        self.__dict__.update(state)
        self.e = np.zeros(shape, e.dtype)
        self.e[rows] = e

    def freeze(self) -> "TextCNN":
        """Build the tables of products that scoring uses: for each offset, the filters of all widths beyond it, side by side."""
        self.tables = [self.e @ np.concatenate([w[o] for w in self.w if len(w) > o], axis=1) for o in range(max(self.widths))]
        return self

    def over(self, e: np.ndarray) -> "TextCNN":
        """The same network over other tokens, whose embeddings are ``e``; scoring only."""
        out = copy.copy(self)
        out.e = e
        return out.freeze()

    def _conv(self, flat: np.ndarray) -> np.ndarray:
        """Activations of all filters at each place; ``widths`` ascend, so that an offset's filters are the last ones."""
        n = len(flat) - (max(self.widths) - 1)
        z = np.empty((n, self.filters * len(self.widths)), np.float32)
        z[:] = np.concatenate(self.b)
        for o in range(max(self.widths)):
            at = flat[o : n + o]
            if self.tables is not None:
                t = self.tables[o].take(at, axis=0)
            else:
                t = self.e[at] @ np.concatenate([w[o] for w in self.w if len(w) > o], axis=1)
            z[:, z.shape[1] - t.shape[1] :] += t
        return z

    def pooled(self, texts: list[np.ndarray], step: int = 1 << 12) -> np.ndarray:
        """Max-pooled activations; long texts go through in pieces that overlap by the filter width."""
        pad = max(self.widths) - 1
        out = np.zeros((len(texts), self.filters * len(self.widths)), np.float32)
        group: list[tuple[int, int]] = []
        size = 0

        def flush():
            if not group:
                return
            flat, starts, inside = flatten([texts[r][at : at + step + pad] for r, at in group], pad)
            flat = np.concatenate([flat, np.zeros(pad, np.int64)])
            z = self._conv(flat)
            z[~inside] = -np.inf
            np.maximum.at(out, np.array([r for r, _ in group]), np.maximum.reduceat(z, starts, axis=0))
            group.clear()

        for r, t in enumerate(texts):
            for at in range(0, max(1, len(t)), step):
                group.append((r, at))
                size += min(step, len(t) - at) + pad
                if size >= step:
                    flush()
                    size = 0
        flush()
        return out

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.pooled(texts) @ self.v + self.c[0]

    def fit(self, texts: list[np.ndarray], y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, sparse: float = 0.0, drop: float = 0.0, average: float = 0.0, clear: bool = False, seed: int = 3) -> "TextCNN":
        """Adam on the logistic loss, weighted to even classes.

        ``sparse``: a rate of its own for the embedding, whose touched rows alone
        are then updated (Adagrad). ``drop``: the share of ids that are left out
        at random in training. ``average``: the share of epochs, the last ones,
        whose mean is the result. ``clear``: embeddings that nothing was learned
        for become zero.
        """
        rng = np.random.default_rng(seed)
        params = [self.v, self.c, *self.w, *self.b, *(() if sparse else (self.e,))]
        m = [np.zeros_like(p) for p in params]
        s = [np.zeros_like(p) for p in params]
        seen = np.full(len(self.e), 1e-8, np.float32)
        t = 0
        n_w = len(self.widths)
        pad = max(self.widths) - 1
        weight = np.where(y == 1, 0.5 / max(1e-6, y.mean()), 0.5 / max(1e-6, 1 - y.mean()))
        mean, counted = None, 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                flat, starts, inside = flatten([texts[r] for r in rows], pad)
                flat = np.concatenate([flat, np.zeros((pad, *flat.shape[1:]), np.int64)])
                if drop:
                    flat = np.where(rng.random(flat.shape) >= drop, flat, PAD)
                n = len(flat) - pad
                doc = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, n)))
                x = self.e[flat]
                x = x.sum(axis=1) if x.ndim == 3 else x
                zs, args = [], []
                for i, k in enumerate(self.widths):
                    z = sum(x[o : n + o] @ self.w[i][o] for o in range(k)) + self.b[i]
                    z[~inside] = -np.inf
                    top = np.maximum.reduceat(z, starts, axis=0)
                    pos, f = np.nonzero(z == top[doc])
                    arg = np.zeros((len(rows), self.filters), np.int64)
                    arg[doc[pos], f] = pos
                    zs.append(np.maximum(top, 0))
                    args.append(arg)
                h = np.concatenate(zs, axis=1)
                p = 1 / (1 + np.exp(-(h @ self.v + self.c[0])))
                g = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
                grads = [np.zeros_like(p_) for p_ in params[: 2 + 2 * n_w]]
                grads[0] = h.T @ g
                grads[1][0] = g.sum()
                dh = np.outer(g, self.v) * (h > 0)
                tokens, slopes = [], []
                for i, k in enumerate(self.widths):
                    d = dh[:, i * self.filters : (i + 1) * self.filters]
                    grads[2 + n_w + i] = d.sum(0)
                    for o in range(k):
                        at_ = args[i] + o
                        grads[2 + i][o] = np.einsum("bfd,bf->df", x[at_], d)
                        tokens.append(at_.ravel())
                        slopes.append((d[:, :, None] * self.w[i][o].T[None]).reshape(-1, self.e.shape[1]))
                grads += self._embedding_grad(flat[np.concatenate(tokens)], np.concatenate(slopes), sparse, seen)
                t += 1
                for p_, g_, m_, s_ in zip(params, grads, m, s):
                    g_ = g_ + decay * p_ if p_.ndim > 1 and p_ is not self.e else g_
                    m_ += 0.1 * (g_ - m_)
                    s_ += 0.001 * (g_ * g_ - s_)
                    p_ -= rate * (m_ / (1 - 0.9**t)) / (np.sqrt(s_ / (1 - 0.999**t)) + 1e-8)
            if average and epoch >= epochs * (1 - average):
                now = [self.e, *params[: 2 + 2 * n_w]]
                counted += 1
                mean = [p_.copy() for p_ in now] if mean is None else [a + (p_ - a) / counted for a, p_ in zip(mean, now)]
        if mean is not None:
            self.e, self.v, self.c, self.w, self.b = mean[0], mean[1], mean[2], mean[3 : 3 + n_w], mean[3 + n_w :]
        if clear and sparse:
            self.e[seen <= 1e-8] = 0
        return self

    def _embedding_grad(self, ids: np.ndarray, slopes: np.ndarray, sparse: float, seen: np.ndarray) -> list[np.ndarray]:
        """The embedding's gradient, or nothing after a sparse step of its own."""
        if not sparse:
            out = np.zeros_like(self.e)
            np.add.at(out, ids.ravel(), np.repeat(slopes, ids.size // len(ids), axis=0))
            out[PAD] = 0
            return [out]
        live = np.abs(slopes).sum(axis=1) > 0
        ids, slopes = ids[live], slopes[live]
        if len(ids):
            own, at = np.unique(ids.ravel(), return_inverse=True)
            total = np.zeros((len(own), slopes.shape[1]), np.float32)
            np.add.at(total, at, np.repeat(slopes, ids.size // len(ids), axis=0))
            total[own == PAD] = 0
            seen[own] += (total**2).mean(axis=1)
            self.e[own] -= sparse * total / np.sqrt(seen[own])[:, None]
        return []


def joined(nets: list[TextCNN]) -> TextCNN:
    """One network whose logit is the mean of those of ``nets``: their embeddings side by side, each filter over its own part."""
    out = copy.copy(nets[0])
    dim, filters, n = out.e.shape[1], out.filters, len(nets)
    out.filters = filters * n
    out.e = np.concatenate([net.e for net in nets], axis=1)
    out.w = [np.zeros((k, dim * n, filters * n), np.float32) for k in out.widths]
    for i, net in enumerate(nets):
        for w, own in zip(out.w, net.w):
            w[:, i * dim : (i + 1) * dim, i * filters : (i + 1) * filters] = own
    out.b = [np.concatenate(b) for b in zip(*(net.b for net in nets))]
    out.v = np.stack([net.v.reshape(len(out.widths), filters) for net in nets], axis=1).ravel() / n
    out.c = np.mean([net.c for net in nets], axis=0)
    return out
