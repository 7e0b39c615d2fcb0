"""Harmonic packing of tokenized documents into sequences.

Lengths fall into reciprocal-capacity classes: class k holds pieces of at most
capacity/k ids, and a bin of class k takes exactly k of them. Each worker fills
the bins of its own partition, so nothing is shuffled and no state is shared.

A document is cut into whole sequences first. Its rest is placed whole where it
nearly fills its class, and otherwise cut at the largest reciprocal capacity
that fits. Bins that are still open when a partition ends are laid end to end
and cut anew, the last of them at powers of two, which need no padding.

Text that spells an added token of the vocabulary (its end-of-text mark) is
ordinary text, or, with ``added_tokens``, that token, as tokenizers reads it by
default.

Defined cases: a null or empty text is one piece with the end id alone;
repeated rows are packed once per row; a null doc_id stays null; an empty table
gives no rows; very long texts are encoded whole, one at a time; ties of length
go by order of arrival; other columns are ignored. Sequence ids are unique per run:
the partition's number in the upper bits, a count in the lower 40.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ipaloom.llm import util

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])

#: A rest that fills its class to this share goes in whole.
FILL = 1 - 1 / 64
#: Rests up to capacity / SMALL are never cut.
SMALL = 64
#: Characters that are tokenized together, or one longer text.
CHUNK = 4_000_000


class Encoder:
    """Ids of the byte-level BPE vocabulary, each distinct word of a chunk of texts encoded once.

    The vocabulary's pattern never joins text across the start of a space that
    precedes a non-space or follows one, so words split there have the ids they
    have in the text. Texts with a space that has white space on both sides go
    through the encoder whole.
    """

    def __init__(self, path: str | None = None, added_tokens: bool = False):
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.n_bytes[list(ranks.values())] = [len(x) for x in ranks]
        self.added: dict[str, int] = {}
        if added_tokens:
            with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
                self.added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self._marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.encode(text), dtype="<u4")

    def _words(self, words: list[str], solid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, counts): each word's ids after a space; ``solid`` words hold no white space and are encoded in one call."""
        joined = [" " + w for w, s in zip(words, solid) if s]
        ids = self.whole("".join(joined))
        ends = np.cumsum([len(w.encode()) for w in joined], dtype=np.int64)
        at = np.cumsum(self.n_bytes[ids])
        last = np.searchsorted(at, ends)
        if len(ends) and not np.array_equal(at[last], ends):
            raise AssertionError("the vocabulary joins words")
        counts = np.zeros(len(words), np.int64)
        counts[solid] = np.diff(last + 1, prepend=0)
        parts = [ids]
        for i in np.flatnonzero(~solid):
            parts.append(self.whole(" " + words[i]))
            counts[i] = len(parts[-1])
        order = np.concatenate([np.flatnonzero(solid), np.flatnonzero(~solid)])
        starts = np.zeros(len(words), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(parts), starts, counts

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; those that spell an added token are cut there, and each stretch is encoded on its own."""
        marked = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if not marked:
            return self._plain(texts)
        out = self._plain(["" if i in set(marked) else t for i, t in enumerate(texts)])
        for i in marked:
            cut = self._marks.split(texts[i])
            stretches = iter(self._plain(cut[::2]))
            out[i] = np.concatenate([np.array([self.added[c]], "<u4") if j % 2 else next(stretches) for j, c in enumerate(cut)])
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets, coded = split.offsets.to_numpy(), split.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        solid = np.fromiter((w.split() == [w] for w in words), bool, len(words))
        opens, closes = ~solid, ~solid
        for i in np.flatnonzero(~solid):
            opens[i], closes[i] = not words[i] or words[i][0].isspace(), not words[i] or words[i][-1].isspace()
        ids, starts, counts = self._words(words, solid)
        n = counts[at]
        n[offsets[:-1]] = 0  # a first word has no space before it
        before = np.concatenate([[0], np.cumsum(n)])
        stream = ids[np.repeat(starts[at] - before[:-1], n) + np.arange(before[-1])]
        loose = closes[at[:-1]] & opens[at[1:]]
        loose[offsets[1:-1] - 1] = False  # pairs across two texts
        loose = np.concatenate([[0], np.cumsum(loose), [0]])
        out = []
        for i, text in enumerate(texts):
            a, b = offsets[i], offsets[i + 1]
            if loose[b - 1] > loose[a]:
                out.append(self.whole(text))
            else:
                out.append(np.concatenate([self.whole(words[at[a]]), stream[before[a] : before[b]]]))
        return out

    def ids(self, text: str) -> np.ndarray:
        return self.batch([text])[0]


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) of at most CHUNK characters, or of one row."""
    ids, texts, n = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        text = text.as_py() or ""
        if texts and n + len(text) > CHUNK:
            yield ids, texts
            ids, texts, n = [], [], 0
        ids.append(doc_id), texts.append(text)
        n += len(text)
    if texts:
        yield ids, texts


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str | None = None, added_tokens: bool = False) -> Encoder:
    """One encoder of a kind per worker process."""
    if (path, added_tokens) not in _encoders:
        _encoders[path, added_tokens] = Encoder(path, added_tokens)
    return _encoders[path, added_tokens]


class Packer:
    """Bins of one partition; ``rows`` gathers finished pieces."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next = capacity, first_sequence
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids)), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        capacity, total, at = self.capacity, len(ids), 0
        while total - at >= capacity:
            self._close([(doc_id, at, ids[at : at + capacity], total)])
            at += capacity
        while (rest := total - at) > 0:
            k = capacity // rest
            if rest * SMALL > capacity and rest * k < FILL * capacity:
                k = -(-capacity // rest)
                rest = capacity // k
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc_id, at, ids[at : at + rest], total))
            if len(bin_) == k:
                self._close(self.open.pop(k))
            at += rest

    def finish(self) -> None:
        """Lay the open bins end to end; sequences are whole until the last, which is cut at powers of two."""
        queue = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p[2]) for p in queue)
        while left:
            size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= size
            pieces = []
            while size:
                doc_id, start, ids, total = queue.pop(0)
                if len(ids) > size:
                    queue.insert(0, (doc_id, start + size, ids[size:], total))
                    ids = ids[:size]
                pieces.append((doc_id, start, ids, total))
                size -= len(ids)
            self._close(pieces)


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, tokenizer_path: str | None = None, added_tokens: bool = False) -> DataFrame:
    """Pieces of all documents (doc_id, text), each with its place in a sequence of at most ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, added_tokens)
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], "<u4")

        def out():
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_ARROW)

        for batch in batches:
            for doc_ids, texts in _chunks(batch):
                for doc_id, ids in zip(doc_ids, enc.batch(texts)):
                    packer.add(doc_id, np.concatenate([ids, end]))
                    if len(packer.rows) >= 50_000:
                        yield out()
        packer.finish()
        util.tidy()
        if packer.rows:
            yield out()

    return util.text_map(docs.select("doc_id", "text"), run, SCHEMA)
