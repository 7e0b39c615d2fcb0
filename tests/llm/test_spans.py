"""op1 and op9 against plain regular expressions."""

import hashlib
import random
import re
import string

import numpy as np
from pyspark.sql import functions as F

from ipaloom.llm import pii, secrets_scan

CASES = [
    "mail a.b+c@d-e.fr.com, x@y and @z.de; a@b.c%d@e.f; ü@ä.de a@b@c.dd", "ip 1.2.3.4 256.1.1.1 1.2.3.4.5 001.02.3.255 1..2.3.4",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 6011000990139424x 4111  1111 1111 1111", "call +1 (017) 555-7713 or +12 +123456789012345678 +4 4+49(30)1234567",
    "😀 visa card 4222222222222 then IBAN DE89 3704 0044 0532 0130 00 and DE88370400440532013000, SSN 123-45-6789", "9" * 50_000, "1 " * 20_000, "a" * 50_000 + "@", "",
]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[::2]) % 10 == sum((2 * x) // 10 + (2 * x) % 10 for x in d[1::2]) * 9 % 10


def brute_pii(t):
    digits = lambda s: sum(c in "0123456789" for c in s)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= digits(s) <= 19 and luhn(s)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= digits(s) <= 15),
    ]
    return {k: [(m.start(), m.end()) for m in re.finditer(rx, t) if ok(m[0])] for k, rx, ok in kinds}


def joined(found):
    return ",".join(f"{k}:{s}:{e}" for k, spans in found.items() for s, e in spans)


def test_pii_is_brute_force(spark, docs):
    texts = [*CASES[:5], *CASES[8:], "7" * 3000, "1 " * 3000, *(r["text"] for r in docs.where("text rlike '[0-9]'").select("text").collect())]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.scan(rows).collect()}
    for i, t in enumerate(texts):
        want = brute_pii(t)
        assert got[i]["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest(), t[:200]
        assert [got[i][f"n_{k}"] for k in want] == [len(v) for v in want.values()]
        assert set(filter(None, joined(want).split(","))) <= set(got[i]["spans"].split(","))
    assert got[4]["n_iban"] == 1 and got[4]["n_ssn"] == 1 and got[4]["n_short_card"] == 1
    s = got[4]["spans"].split(",")
    assert s == sorted(s, key=lambda x: (pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1])))


def test_pii_survives_long_runs(spark, odd, empty):
    rows = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    assert pii.scan(rows).where("n_email + n_ip + n_card + n_phone >= 0").count() == len(CASES)
    got = pii.scan(odd).collect()
    assert len(got) == 10 and sum(r["n_email"] for r in got) == 1 and pii.scan(empty).count() == 0
    assert all(r["spans"] == "" for r in got if r["doc_id"] in (1, 2, 3))


def brute_secrets(t):
    kinds = [
        (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    return sorted((m.start(), k, m.end()) for k, (rx, ok) in enumerate(kinds) for m in re.finditer(rx, t) if ok(m))


SECRETS = ['Token = "abcdef0123" ſecret=zzzzzzz apiKey:xy api_key==abcdefg PASSWD:"abc"', "AKIA" + "A1" * 10 + " xAKIA" + "B" * 16 + "é" + "0123456789abcdef" * 2, "token=" + "deadbeef" * 4]


def test_secrets_base_is_brute_force(spark, docs):
    texts = [*SECRETS, "", *(r["text"] for r in docs.select("text").collect())]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets_scan.scan(rows).collect()}
    for i, t in enumerate(texts):
        want = secrets_scan._digest(brute_secrets(t))
        assert got[i]["base"] == want and got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))
    assert sum(r["n_key"] for r in got.values()) <= 2  # nothing else is hidden in these documents


def test_secret_network_on_unseen_findings():
    model = secrets_scan.fit()
    found = secrets_scan.labelled_findings(600, seed=99)
    yes = model.accepts([secrets_scan._window(t, a, b) for t, a, b, _ in found])
    labels = [label for *_, label in found]
    assert sum(y for y, x in zip(yes, labels) if x) / sum(labels) > 0.9
    assert sum(y for y, x in zip(yes, labels) if not x) / (len(labels) - sum(labels)) < 0.1


def test_secrets_odd_rows_and_redaction(spark, odd, empty):
    assert secrets_scan.scan(odd).count() == 10 and secrets_scan.scan(empty).count() == 0
    rows = spark.createDataFrame([(1, "a token = abcdef1234 b", 22), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in secrets_scan.redact(rows).collect()}
    assert got[1]["text"] == "a [secret] b" and got[1]["n_chars"] == 12 and got[2]["text"] is None and got[3]["text"] == "clean"
    assert secrets_scan.masked("abcdef", [(1, 0, 3), (2, 1, 4)], "_") == "a_ef"
    assert secrets_scan.redact(odd).columns == odd.columns
    assert secrets_scan.scan(docs_of(spark)).agg(F.sum("n_assign")).first()[0] == 1


def docs_of(spark):
    return spark.createDataFrame([(1, "token: abcdefgh")], "doc_id long, text string")


def test_secrets_inside_long_runs():
    model, rng = secrets_scan.fit(), random.Random(1)
    words = "docs guide install linux server config release notes module handler account settings thumb large index public build target".split()
    path = lambda n: "".join(rng.choice(words) + rng.choice("/-_") for _ in range(n))
    key = lambda: "ghp_" + "".join(rng.choices(string.ascii_letters + string.digits, k=36))
    for n in (8, 20, 100):
        ends = [(path(n), path(n)) for _ in range(100)]
        found = {k: secrets_scan.spans_of([f"see {a}{middle()}/{b}9 end" for a, b in ends], model) for k, middle in (("key", key), ("none", lambda: "17"))}
        assert sum(len(s) for _, s in found["key"]) >= 90 and sum(len(s) for _, s in found["none"]) <= 5


def test_secret_threshold_keeps_the_recall():
    # most scores are under 0.5; the share must hold all the same
    p = np.concatenate([np.linspace(0.05, 0.4, 150), np.linspace(0.6, 0.99, 37)])
    t = secrets_scan.threshold_for(p, 0.97)
    assert t < 0.5 and (p >= t).mean() >= 0.97 > (p > t).mean()
    # 13 findings leave no room for a miss; an interpolated quantile would miss one
    assert secrets_scan.threshold_for(np.arange(13) / 13, 0.97) == 0
    # one epoch without learning to speak of: the fitted model keeps its promise on the held-out findings
    model = secrets_scan.fit(600, 0.97, 1)
    for n, seed, long in ((600, 17, False), (600, 18, True)):
        found = secrets_scan.labelled_findings(n, seed, long)
        held = [secrets_scan._window(t, a, b) for i, (t, a, b, label) in enumerate(found) if i // 2 % 3 == 2 and label]
        assert model.accepts(held).mean() >= 0.97 - 1e-9
