"""Secret scans: patterns propose, a character network judges every candidate in its context.

Base kinds are assign, access and hex (see BASE); all their matches are
reported. Candidates are

* every base match, whose score is reported;
* ``run``: runs of 20 or more key characters that hold a letter and a digit;
* ``rest``: what base matches leave uncovered of such a run or next to an access
  or hex match, with 8 letters or digits or more;
* ``short``: words of 8 to 19 characters with a digit, a lower-case and an
  upper-case letter, at most LEFT characters behind a word such as login.

A convolutional network over the characters of the whole candidate, however
long, and of the text around it, trained in numpy on labelled findings, judges
all of them. Beyond the base matches those it accepts are spans of kind ``key``.
Each of run, rest and short has a threshold: the largest that keeps ``recall``
of its held-out findings (of plain and of joined ones for run).

The labelled findings are generated, as no table labels any: keys in the formats
that public services document (FAMILIES), and harmless strings of like length
(identifiers, paths, versions, dates, unique ids, repeated text), each in several
surroundings; long runs of paths and joined identifiers with and without a key
inside; tails behind access keys and digests; and passwords beside words such as
login, against product names and versions. ``family_recall`` measures recall on
a family that training did not see.

Defined cases: a null text counts as empty and has no spans; repeated rows are
reported alike; a null doc_id stays null; very long texts are searched whole;
overlapping spans are all reported and redacted as one; an empty table gives no
rows; other columns are ignored by ``scan`` and kept by ``redact``. Positions are
code points, the end exclusive.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ipaloom.llm import util
from ipaloom.llm.textcnn import TextCNN

#: Kinds in their order: pattern, and which matches count.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}
KINDS = [*BASE, "key"]
#: Substrings of the lower-cased text without which no assignment can match.
_NAMES = ("passw", "secret", "token", "api")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
LEFT, RIGHT = 24, 12
_LONG = 20
#: Letters and digits of a rest, and characters of a short candidate.
_REST, _SHORT = 8, (8, 19)
_KEYS = re.compile(r"[A-Za-z0-9+/_=-]*")
_DIGIT = re.compile(r"[0-9][!-~]*")
_WORD_LEFT = re.compile(r"[!-~]*\Z")
_LOGIN = re.compile("login|pass|pwd|pin|credential|auth|secret|key|token|user|account|contrase", re.I)
_OUTER = "\"'`()[]{}<>,;:.="
SHAPES = ("run", "rest", "short")
FAMILIES = ("ghp", "sk", "sk_live", "xoxb", "eyJ", "letters", "padded", "capitals", "AIza")


def _window(text: str, start: int, end: int) -> np.ndarray:
    """Character ids of a candidate, which is ASCII, and its context."""
    code = lambda s: np.array([1 + min(ord(c), 127) for c in s], np.int16)
    inside = np.frombuffer(text[start:end].encode("ascii"), np.uint8).astype(np.int16) + 130
    return np.concatenate([code(text[max(0, start - LEFT) : start]), inside, code(text[end : end + RIGHT])])


@dataclass
class Model:
    cnn: TextCNN
    thresholds: dict[str, float]

    @property
    def threshold(self) -> float:
        return self.thresholds["run"]

    def scores(self, windows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.cnn.logits(windows).astype(float), -30, 30))) if windows else np.zeros(0)

    def accepts(self, windows: list[np.ndarray], shape: str = "run") -> np.ndarray:
        return self.scores(windows) >= self.thresholds[shape]


def labelled_findings(n: int, seed: int = 17, long: bool = False, shape: str = "run", without: str | None = None, only: str | None = None) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of generated findings, half of them secrets.

    ``long`` runs are joined words, with a key inside if they are secrets.
    ``without`` and ``only`` leave a family of keys out, or all others.
    """
    rng = np.random.default_rng(seed)
    pick = lambda s: s[int(rng.integers(len(s)))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    b62, hexa = string.ascii_letters + string.digits, string.hexdigits[:16]
    syllables = ["an", "re", "ti", "lo", "der", "ing", "men", "ka", "sol", "est", "ver", "on", "eau", "cion", "lich"]
    onsets = ["", "b", "c", "d", "f", "g", "h", "j", "l", "m", "n", "p", "qu", "r", "s", "t", "v", "w", "bl", "br", "ch", "cl", "cr", "dr", "fl", "fr", "gr", "ph", "pl", "pr", "sh", "sk", "sp", "st", "str", "th", "tr"]
    nuclei, codas = ["a", "e", "i", "o", "u", "ai", "ea", "ee", "ie", "oo", "ou", "au", "y"], ["", "", "n", "r", "l", "s", "t", "d", "m", "ng", "nt", "nd", "st", "ck", "ct", "x", "mb", "ld", "ll", "ss", "rm", "pt"]
    syllable = lambda: pick(syllables) if rng.integers(3) == 0 else pick(onsets) + pick(nuclei) + pick(codas)
    word = lambda: "".join(syllable() for _ in range(int(rng.integers(1, 4))))
    words = lambda k: " ".join(word() for _ in range(k))
    size = lambda: int(rng.integers(20, 65))
    families = {
        "ghp": lambda: "ghp_" + chars(b62, 36),
        "sk": lambda: "sk-" + chars(b62, 40),
        "sk_live": lambda: "sk_live_" + chars(b62, 24),
        "xoxb": lambda: "xoxb-" + chars(string.digits, 11) + "-" + chars(b62, 24),
        "eyJ": lambda: "eyJ" + chars(b62 + "-_", size()),
        "letters": lambda: chars(b62, size()),
        "padded": lambda: chars(b62 + "+/", size()) + "==",
        "capitals": lambda: chars(string.ascii_uppercase + string.digits, size()),
        "AIza": lambda: "AIza" + chars(b62 + "-_", 35),
    }
    good = [f for k, f in families.items() if k != without and only in (None, k)]
    bad = [
        lambda: "_".join(word() for _ in range(6)) + str(rng.integers(1, 100)),
        lambda: "-".join(word() for _ in range(6)) + "-" + str(rng.integers(1, 9999)),
        lambda: "/".join(word() for _ in range(6)) + "/" + str(rng.integers(1, 99)),
        lambda: "".join(word().capitalize() for _ in range(5)) + str(rng.integers(1, 99)),
        lambda: "-".join(chars(hexa, k) for k in (8, 4, 4, 4, 12)),
        lambda: f"20{rng.integers(10, 30)}-0{rng.integers(1, 9)}-1{rng.integers(0, 9)}T1{rng.integers(0, 9)}-" + str(rng.integers(10, 60)) + "-00-000",
        lambda: word() * 8 + str(rng.integers(0, 9)),
        lambda: "=" * 20 + str(rng.integers(0, 99)) + word() + "-" * 10,
        lambda: chars(string.digits, 20) + pick("abcxyz"),
        lambda: word() + "".join(word() for _ in range(6)) + str(rng.integers(1, 9)),
    ]
    around = [
        (lambda: f"{words(3)} = \"", '" '), (lambda: f"{words(2)}: ", "\n"), (lambda: "Authorization: Bearer ", "\n"),
        (lambda: f"export {word().upper()}=", "\n"), (lambda: words(4) + " ", " "), (lambda: words(3) + " (", ") "), (lambda: "", ""),
    ]

    def joined() -> str:
        """Path, identifier or parameters of 30 characters or more, with a number here and there; its parts stand behind one mark or behind any."""
        mark, mixed, parts = pick("//--__="), rng.integers(2), []
        while sum(map(len, parts)) < size() + 10:
            shape = int(rng.integers(8))
            parts.append(str(rng.integers(0, 3000)) if shape == 0 else word().capitalize() if shape == 1 else word())
        return "".join(p + (pick("/-_") if mixed else mark) for p in parts[:-1]) + parts[-1]

    def run(label: int) -> str:
        mark = pick("//-_=")
        middle = [pick(good)()] if label else [pick(bad)()] if rng.integers(2) else []
        return mark.join([*(joined() for _ in range(int(rng.integers(1, 4)))), *middle, *(joined() for _ in range(int(rng.integers(1, 4)))), str(rng.integers(0, 99))])

    def tail(label: int) -> tuple[str, str]:
        """An access key or digest, and what follows it."""
        before = pick(["AKIA" + chars(string.ascii_uppercase + string.digits, int(rng.integers(16, 24))), chars(hexa, int(rng.integers(24, 65)))])
        mark = pick(["", "+", "/", "-", "_", "="]) if label else pick("/-_=")
        parts = lambda: mark.join(pick([word(), word().capitalize(), str(rng.integers(0, 3000))]) for _ in range(int(rng.integers(2, 5))))
        return before, mark + (chars(b62 + "+/", int(rng.integers(8, 40))) if label else word() + mark + parts() + mark + word())

    def password() -> str:
        base = [chars(b62 + "!#$%&*+-?@^_", int(rng.integers(8, 20))), word() + str(rng.integers(1, 99)) + pick("-_.!#@") + word().capitalize() + pick("!#$?*"), word().capitalize() + chars(string.digits + "!@#$", 4) + word()]
        out = pick(base)[: _SHORT[1]]
        return out + "aA7#"[: max(0, _SHORT[0] - len(out))]

    def name() -> str:
        base = [word().capitalize() + str(rng.integers(1, 30)) + word().capitalize(), "v" + str(rng.integers(1, 9)) + "." + str(rng.integers(0, 99)) + "-" + word().capitalize() + str(rng.integers(0, 9)), word().upper() + "-" + str(rng.integers(1, 9999)) + word(), word().capitalize() + "-" + word() + str(rng.integers(1900, 2030)), pick("ie") + word().capitalize() + str(rng.integers(1, 30)) + pick(["", word().capitalize()]) + "X", "h" + str(rng.integers(1, 9)) + word().capitalize() + pick(["", "%", "###", "!!", "***"]) + word()]
        return pick(base)[: _SHORT[1]]

    login = ["login", "passphrase", "pwd", "pass", "credentials", "user pass", "Passwort", "mot de passe", "contrase\u00f1a", "password is"]
    out = []
    for i in range(n):
        label = i % 2
        if shape == "short":
            body = password() if label else name()
            left, after = f"{words(2)} {pick(login)}" + pick([": ", " = ", " ", " \""]), pick([" ", "\n", "\" ", ", "])
        elif shape == "rest":
            before, body = tail(label)
            left, after = pick(around)[0]() + before, pick([" ", "\n", "\" "])
        else:
            body = run(label) if long else pick(good if label else bad)()
            if len(body) < _LONG:
                body += chars(string.digits, _LONG - len(body)) if label else "-" + "".join(word() for _ in range(10))
            before, after = pick(around)
            left = before()
        out.append((left + body + after + words(2), len(left), len(left) + len(body), label))
    return out


def _findings(examples: int, without: str | None = None) -> list[tuple[str, list]]:
    return [
        ("run", labelled_findings(examples, without=without)), ("run", labelled_findings(examples // 2 * 2, 18, long=True, without=without)),
        ("rest", labelled_findings(examples // 4 * 2, 19, shape="rest")), ("short", labelled_findings(examples // 2 * 2, 20, shape="short")),
    ]


@functools.cache
def fit(examples: int = 3000, recall: float = 0.97, epochs: int = 16, without: str | None = None) -> Model:
    """Train on generated findings, ``examples`` of each sort; a third is held out to set the thresholds; the last half of the epochs is averaged."""
    sorts = _findings(examples, without)
    x = [_window(t, a, b) for _, found in sorts for t, a, b, _ in found]
    y = np.array([label for _, found in sorts for *_, label in found], np.float32)
    sort = np.repeat(np.arange(len(sorts)), [len(found) for _, found in sorts])
    out = np.concatenate([np.arange(len(found)) // 2 % 3 == 2 for _, found in sorts])
    cnn = TextCNN(260, 12, (2, 3, 5), 12, seed=5)
    cnn.fit([v for v, o in zip(x, out) if not o], y[~out], epochs=epochs, average=0.5)
    model = Model(cnn.freeze(), {})
    p = model.scores([v for v, o in zip(x, out) if o])
    for shape in SHAPES:
        model.thresholds[shape] = min(threshold_for(p[(y[out] == 1) & (sort[out] == k)], recall) for k, (s, _) in enumerate(sorts) if s == shape)
    return model


def family_recall(family: str, examples: int = 3000, n: int = 600) -> tuple[float, float]:
    """Recall on ``family``, which training did not see, and the share of harmless strings that are taken for keys."""
    model, found = fit(examples, without=family), labelled_findings(n, 23, only=family)
    yes = model.accepts([_window(t, a, b) for t, a, b, _ in found])
    label = np.array([x for *_, x in found]) == 1
    return float(yes[label].mean()), float(yes[~label].mean())


def threshold_for(p: np.ndarray, recall: float) -> float:
    """The largest threshold that at least the share ``recall`` of ``p`` reach."""
    return float(np.sort(p)[len(p) - int(np.ceil(recall * len(p) - 1e-9))])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all base matches."""
    low = text.lower()
    long_ = any(len(w) >= _LONG for w in text.split())
    spans = []
    if any(n in low for n in _NAMES):
        spans += [(m.start(), 0, m.end()) for m in BASE["assign"][0].finditer(text) if BASE["assign"][1](m)]
    if long_:
        for i, kind in enumerate(("access", "hex"), 1):
            rx, counts = BASE[kind]
            spans += [(m.start(), i, m.end()) for m in rx.finditer(text) if counts(m)]
    return spans


def _mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, shape) of what may be a secret beside the base matches."""
    runs = {}
    if any(len(w) >= _LONG for w in text.split()):
        runs = {m.start(): m.end() for m in _CANDIDATE.finditer(text) if _mixed(m[0])}
        for s, k, e in base:  # what stands next to an access or hex match, whatever it is
            if k:
                left = s
                while left and _KEYS.fullmatch(text[left - 1]) and text[left - 1]:
                    left -= 1
                runs[left] = max(runs.get(left, 0), _KEYS.match(text, e).end())
    taken = sorted((s, e) for s, _, e in base)
    out, i = [], 0
    for s, e in sorted(runs.items()):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        at, j, covered = s, i, False
        while j < len(taken) and taken[j][0] < e:
            covered = True
            if taken[j][0] > at:
                out.append((at, taken[j][0], "rest"))
            at = max(at, taken[j][1])
            j += 1
        if at < e:
            out.append((at, e, "rest" if covered else "run"))
    out = [(s, e, k) for s, e, k in out if k == "run" or sum(c.isalnum() for c in text[s:e]) >= _REST]
    spans = sorted([*taken, *((s, e) for s, e, _ in out)])
    starts = [s for s, _ in spans]
    furthest = list(itertools.accumulate((e for _, e in spans), max))
    for m in _DIGIT.finditer(text):
        s = m.start() - len(_WORD_LEFT.search(text[max(0, m.start() - 64) : m.start()])[0])
        body = text[s : m.end()]
        e = m.end() - (len(body) - len(body.rstrip(_OUTER)))
        s += len(body) - len(body.lstrip(_OUTER))
        if _SHORT[0] <= e - s <= _SHORT[1] and any(c.islower() for c in text[s:e]) and any(c.isupper() for c in text[s:e]) and _LOGIN.search(text[max(0, s - LEFT) : s]):
            before = bisect.bisect_left(starts, e)
            if not before or furthest[before - 1] <= s:
                out.append((s, e, "short"))
    return sorted(out)


def judged(texts: list[str], model: Model) -> list[tuple[list, list, list]]:
    """For each text: its base spans and all its spans, as (start, kind's number, end), sorted, and the network's scores of the latter."""
    out, windows, where = [], [], []
    for i, text in enumerate(texts):
        base = sorted(base_spans(text))
        out.append((base, [], []))
        for s, k, e in base:
            windows.append(_window(text, s, e))
            where.append((i, s, k, e, 0.0))
        for s, e, shape in candidates(text, base):
            windows.append(_window(text, s, e))
            where.append((i, s, len(BASE), e, model.thresholds[shape]))
    found: list[list] = [[] for _ in texts]
    for (i, s, k, e, least), p in zip(where, model.scores(windows)):
        if p >= least:
            found[i].append(((s, k, e), float(p)))
    for (_, spans, scores), rows in zip(out, found):
        rows.sort()
        spans += [r for r, _ in rows]
        scores += [p for _, p in rows]
    return out


def spans_of(texts: list[str], model: Model) -> list[tuple[list, list]]:
    """For each text: its base spans and all its spans, as (start, kind's number, end), sorted."""
    return [(base, spans) for base, spans, _ in judged(texts, model)]


def _digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_key, base, base_sha256, spans, scores); base and spans are joined kind:start:end, scores the network's for each span."""
    spark = docs.sparkSession
    util.ship(spark)
    shared = spark.sparkContext.broadcast(model or fit())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = judged([t.as_py() or "" for t in batch.column(1)], shared.value)
            n = [[sum(k == i for _, k, _ in spans) for _, spans, _ in found] for i in range(len(KINDS))]
            base = [_digest(b) for b, _, _ in found]
            texts = [base, [hashlib.sha256(b.encode()).hexdigest() for b in base], [_digest(s) for _, s, _ in found], [",".join(f"{p:.3f}" for p in ps) for _, _, ps in found]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in n), *(pa.array(c, pa.string()) for c in texts)], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "base_sha256", "spans", "scores"]
            )
        util.tidy()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, base_sha256 string, spans string, scores string")


def masked(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with every stretch that spans cover, or that touching ones cover together, replaced by ``mark``."""
    parts, at = [], -1
    for s, _, e in spans:
        if s > at:
            parts += [text[max(at, 0) : s], mark]
        at = max(at, e)
    return "".join([*parts, text[max(at, 0) :]])


def redact(docs: DataFrame, model: Model | None = None, mark: str = "[secret]") -> DataFrame:
    """``docs`` with all secrets in text replaced; n_chars, where it is a long, follows."""
    spark = docs.sparkSession
    util.ship(spark)
    shared = spark.sparkContext.broadcast(model or fit())
    names = docs.columns
    at_text = names.index("text")
    at_chars = names.index("n_chars") if dict(docs.dtypes).get("n_chars") == "bigint" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(at_text)]
            found = spans_of([t or "" for t in texts], shared.value)
            if any(spans for _, spans in found):
                new = [masked(t, spans, mark) if spans else t for t, (_, spans) in zip(texts, found)]
                columns = batch.columns
                columns[at_text] = pa.array(new, columns[at_text].type)
                if at_chars is not None:
                    old = columns[at_chars].to_pylist()
                    columns[at_chars] = pa.array([len(t) if spans else n for t, n, (_, spans) in zip(new, old, found)], pa.int64())
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch
        util.tidy()

    return docs.mapInArrow(run, docs.schema)
