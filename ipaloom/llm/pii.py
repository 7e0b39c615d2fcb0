r"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is a column expression, so a scan is one narrow stage. Base kinds are
email, ip, card and phone; the method adds

* ``iban``: country, check digits and up to 30 characters, confirmed by mod 97;
* ``card``: runs of 13 to 15 digits that pass Luhn with a payment word nearby;
* ``ssn``: ddd-dd-dddd with a social-security word nearby.

Patterns are written so that matching stays linear in the text: a run of its
characters can only start a match at its beginning or where the last one ended,
and repeated groups are possessive.

Defined cases: a null text counts as empty and has no spans; repeated rows are
reported alike; a null doc_id stays null; other columns are ignored. Positions
are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ipaloom.llm.util import let

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"
SSN = r"\b(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}\b"
PART = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
#: Words near a span that raise its score, by kind.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|contact|write|mailto)\b",
    "ip": r"(?i)\b(?:ip|address|server|host|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|téléphone|teléfono)\b",
    "iban": r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social security)\b",
}
#: Score without and with a context word.
SCORES = {"email": (0.9, 1.0), "ip": (0.6, 0.9), "card": (0.8, 1.0), "phone": (0.7, 0.95), "iban": (0.9, 1.0), "ssn": (0.2, 0.9)}
NEAR = 40
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
_TYPE = "array<struct<start:int,end:int,m:string>>"


def find_spans(text: Column, pattern: str) -> Column:
    """All matches with their places: pieces between matches and matches alternate, and their lengths add up."""
    rx = F.lit(pattern)

    def walk(pieces: Column, found: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_TYPE).alias("out"))

        def step(state: Column, x: Column) -> Column:
            at = state["at"] + F.char_length(x["p"])
            end = at + F.char_length(x["m"])
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(at.alias("start"), end.alias("end"), x["m"].alias("m")))).alias("out"))

        pairs = F.filter(F.arrays_zip(pieces.alias("p"), found.alias("m")), lambda x: x["m"].isNotNull())
        return F.aggregate(pairs, start, step, lambda s: s["out"])

    return let(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, rx, F.lit(0)).alias("m")), lambda x: walk(x["p"], x["m"]))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the digits of ``s`` pass the Luhn checksum."""
    values = F.transform(F.split(F.reverse(s), ""), lambda c: c.try_cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).otherwise((v * 2) % 10 + F.floor(v * 2 / 10).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def mod97(s: Column) -> Column:
    """Whether an account number, four characters moved to its end and letters read as 10 to 35, is 1 modulo 97."""
    plain = F.replace(s, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    return (
        F.aggregate(
            F.filter(F.split(turned, ""), lambda c: c != ""),
            F.lit(0),
            lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
        )
        == 1
    )


def _near(text: Column, x: Column, kind: str) -> Column:
    left = F.greatest(x["start"] - NEAR, F.lit(0))
    around = F.concat(F.substr(text, left + 1, x["start"] - left), F.lit(" "), F.substr(text, x["end"] + 1, F.lit(NEAR)))
    return around.rlike(CONTEXT[kind])


def _of(text: Column, kind: str, only_if: Column, pattern: str, good) -> Column:
    spans = F.filter(find_spans(text, pattern), good)
    return F.when(only_if, spans).otherwise(F.array().cast(_TYPE))


def _base(text: Column) -> dict[str, Column]:
    n = lambda x: F.char_length(digits(x["m"]))
    return {
        "email": _of(text, "email", F.contains(text, F.lit("@")), EMAIL, lambda x: F.lit(True)),
        "ip": _of(text, "ip", F.contains(text, F.lit(".")) & text.rlike(r"[0-9]\.[0-9]"), IP, lambda x: F.forall(F.split(x["m"], r"\."), lambda p: p.rlike(PART))),
        "card": _of(text, "card", text.rlike("[0-9][0-9 -]{14}"), CARD, lambda x: n(x).between(16, 19) & luhn(digits(x["m"]))),
        "phone": _of(text, "phone", F.contains(text, F.lit("+")), PHONE, lambda x: n(x).between(8, 15)),
    }


def _added(text: Column) -> dict[str, Column]:
    n = lambda x: F.char_length(digits(x["m"]))
    return {
        "card": _of(text, "card", text.rlike("[0-9][0-9 -]{11}"), CARD, lambda x: n(x).between(13, 15) & luhn(digits(x["m"])) & _near(text, x, "card")),
        "iban": _of(text, "iban", text.rlike(r"\b[A-Z]{2}[0-9]{2}"), IBAN, lambda x: F.char_length(F.replace(x["m"], F.lit(" "), F.lit(""))).between(15, 34) & mod97(x["m"])),
        "ssn": _of(text, "ssn", text.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), SSN, lambda x: _near(text, x, "ssn")),
    }


def _score(text: Column, x: Column, kind: str) -> Column:
    low, high = SCORES[kind]
    return F.when(_near(text, x, kind), F.lit(high)).otherwise(F.lit(low))


def _entries(text: Column, spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.concat_ws(":", F.lit(kind), x["start"], x["end"]).alias("name"), _score(text, x, kind).alias("score")))


def _names(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, email, ip, card, phone: base spans; n_iban, n_ssn; base, spans, scores).

    ``base`` and ``spans`` are joined kind:start:end by kind, then start;
    ``scores`` holds a confidence for each entry of ``spans``.
    """
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base, added = _base(text), _added(text)
    rows = rows.select("doc_id", "text", *[c.alias(k) for k, c in base.items()], *[c.alias(f"more_{k}") for k, c in added.items()])
    joined = lambda kinds: F.concat_ws(",", F.flatten(F.array(*[_names(F.col(k), k) for k in kinds])))
    of = lambda k: [c for c in (k, f"more_{k}") if c in rows.columns]
    everything = F.flatten(F.array(*[F.array_sort(F.concat(*[_entries(text, F.col(c), k) for c in of(k)])) for k in KINDS]))
    rows = rows.withColumn("base", joined(list(base)))
    rows = rows.withColumn("all", F.when(F.greatest(*[F.size(c) for k in KINDS for c in of(k)]) > 0, everything))
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("all", lambda x: x["name"])).alias("spans"),
        F.size("more_iban").cast("long").alias("n_iban"),
        F.size("more_ssn").cast("long").alias("n_ssn"),
        F.size("more_card").cast("long").alias("n_short_card"),
        F.concat_ws(",", F.transform("all", lambda x: x["score"].cast("string"))).alias("scores"),
    )
