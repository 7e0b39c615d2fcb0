"""op4, op6, op5, op7 and op2 against plain Python."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ipaloom.llm import components, decontam, fingerprint, neardup, packing, urls


def check_packing(rows, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = total = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / max(total, 1)


def test_packing_is_a_round_trip(spark, docs, odd, empty):
    odd_texts = ["a  b", " a", "a \n b", "\n\n  x", "it's  ", "日本語 テスト", "<|endoftext|> x", "é" * 3000, "x\ty  z\x00", "😀 👍🏽 z", "\u00a0a\u2003b c", None, "", "1 22 333", "a\r\n b"]
    texts = dict(enumerate([*odd_texts, *(r["text"] for r in docs.limit(300).collect())]))
    rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert check_packing(rows, texts) < 0.01
    assert packing.pack(empty).count() == 0
    assert packing.pack(odd).select(F.sum("length")).first()[0] == packing.pack(odd).select("doc_tokens", "doc_id", "start").where("start = 0").select(F.sum("doc_tokens")).first()[0]


def test_encoder_equals_the_tokenizer_on_any_white_space():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    r = random.Random(3)
    parts = ["a", "B", "\u00e9", " ", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "'s", "12", "-", "\u6f22", "\u200d", "\r\n"]
    texts = ["", " ", "a   b", "a\n \nb", *("".join(r.choices(parts, k=r.randrange(40))) for _ in range(3000))]
    expected = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in packing.encoder().batch(texts)] == expected
    assert [packing.encoder().ids(x).tolist() for x in texts[:300]] == expected[:300]


def test_fingerprints(spark, docs, odd, empty):
    got = {r["doc_id"]: r for r in fingerprint.compare_edited(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    order = sorted(texts)
    for i, d in enumerate(order):
        t, follow = texts[d], texts[order[(i + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    long_ = [r for d, r in got.items() if len(texts[d]) > 2000]
    assert np.mean([r["near_edited"] for r in long_]) > 0.35 and np.mean([r["near_next"] for r in long_]) < 0.1
    same = collections.defaultdict(set)
    for d, r in got.items():
        same[texts[d]].add(r["fingerprint"])
    assert all(len(s) == 1 for s in same.values())
    got = fingerprint.compare_edited(odd).collect()
    assert len(got) == 10 and all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    assert fingerprint.compare_edited(empty).count() == 0
    assert fingerprint.compare_edited(odd.where("doc_id = 7")).first()["near_next"] == 1.0


def test_short_texts_have_a_fingerprint(spark):
    rng = random.Random(6)
    texts = {i: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(5 + i % 4)) for i in range(800)}
    rows = spark.createDataFrame([*texts.items(), *((1000 + i, t) for i, t in texts.items())], "doc_id long, text string")
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(rows).collect()}
    assert all(got[i] and got[i] == got[1000 + i] for i in texts) and len({got[i] for i in texts}) == len(texts)


def brute_groups(texts, k, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in texts.items()}
    by = collections.defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    label = {i: i for i in texts}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in sets.items():
        shared = collections.Counter(j for x in s for j in by[x] if j > i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return {i: find(i) for i in texts}


def family(seed=4, n=120, size=60):
    """Copies of one text with a growing number of changed words, and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    base = [word() for _ in range(size)]
    texts = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(size)] = word()
        texts.append(" ".join(w) if i % 3 else " ".join(word() for _ in range(size)))
    return texts


def test_near_duplicates_are_brute_force(spark, docs, odd, empty, monkeypatch):
    texts = dict(enumerate([*family(), *(r["text"] for r in docs.orderBy("doc_id").limit(250).collect()), *family()[:5]]))
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for k, block in ((2, 100_000), (5, 100_000), (2, 1_500)):
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = {r["doc_id"]: r["component_id"] for r in neardup.groups(rows, k, 80).collect()}
        assert got == brute_groups(texts, k, 80)
    got = neardup.groups(odd, 5, 80).collect()
    assert len(got) == 10 and {r["component_id"] for r in got if r["doc_id"] in (5, 6)} == {5}
    assert all(r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] for r in got if r["doc_id"] in (1, 2, 3))
    assert neardup.groups(empty).count() == 0
    kept = neardup.dedup(odd)
    assert kept.columns == odd.columns and kept.count() == 8


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    for share in (0.5, 0.8, 0.95):
        n = int(2000 * share / (1 + share))
        b = np.concatenate([a[:n], rng.integers(0, 1 << 63, 1000 - n, dtype=np.uint64)])
        x, y = neardup.registers(a), neardup.registers(b)
        got = neardup.estimate(np.array([(x == y).sum()]), np.array([(x > y).sum()]), 1000, np.array([1000]))[0]
        assert abs(got - share) < 0.15
    assert (neardup.registers(a) == np.maximum(neardup.registers(a[:400]), neardup.registers(a[400:]))).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == label
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_decontamination_is_brute_force(spark, docs, odd, empty):
    import re

    rng = random.Random(8)
    base = [r["text"] for r in docs.orderBy("doc_id").limit(120).collect()]
    items = {i: " ".join(t.split()[5:40]) for i, t in enumerate(base[:20])} | {50: "short one", 51: None, 52: " ", 53: base[0][:200], 54: base[0][:200]}
    texts = dict(enumerate(base)) | {500: "Short, ONE!", 501: None, 502: ""}
    for i in range(20):
        w = items[i].split()
        if w:
            w[rng.randrange(len(w))] = "changed"
        texts[600 + i] = base[60 + i] + " " + " ".join(w).upper() + " " + base[80 + i]
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    cut = lambda w: {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} - {""}
    own = {d: cut(words(t)) for d, t in texts.items()}
    want = {(d, i) for i, t in items.items() for d, s in own.items() if (x := cut(words(t))) and len(x & s) >= 0.8 * len(x) - 1e-9}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.search(rows, bench).collect()} == want
    clean = decontam.decontaminate(rows, bench)
    assert {r["doc_id"] for r in clean.collect()} == set(texts) - {d for d, _ in want} and clean.columns == rows.columns
    assert decontam.search(odd, bench).count() == 0 and decontam.search(empty, bench).count() == 0
    assert decontam.decontaminate(odd, bench.where("1 = 0")).count() == 10


def test_urls(spark):
    cases = {
        "http://a.example.com/en/x": ("example.com/en/", "block"), "https://WWW.Example.com/en/?q": ("www.example.com/en/", "allow"), "http://x.net/fr/": ("net/fr/", "block"), "http://x.net": (None, "allow"),
        "ftp://casino-win.example.org/": (None, "block"), "//x": (None, "allow"), None: (None, "allow"), "http://bets.com/": ("com/", "allow"), "http://example.com": (None, "allow"), "a://b://c/d": (None, "allow"), "http://x.spam.net?://com/": (None, "block"),
    }
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judge(rows).collect()}
    for i, (u, (rule, verdict)) in enumerate(cases.items()):
        assert (got[i]["rule"], got[i]["verdict"]) == (rule, verdict), u
    assert got[1]["host"] == "www.example.com" and got[1]["path"] == "/en/" and (got[6]["host"], got[6]["path"]) == ("", "")
    assert urls.judge(rows.where("1 = 0")).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    for bits in (1 << 22, 2200):
        cascade = urls.build_cascade(universe, max_bits=bits)
        assert len(cascade.levels) > 1 and universe.where(cascade.has(F.col("key")) != F.col("listed")).count() == 0
    assert urls.build_cascade(universe, max_bits=100) is None
    host = universe.select(F.col("key"), F.lit(False).alias("listed"))
    assert host.where(urls.build_cascade(host).has(F.col("key"))).count() == 0
