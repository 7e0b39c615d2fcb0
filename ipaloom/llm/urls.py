"""URL filtering by a cascade of Bloom filters, with allow and block rules on top.

Level 1 of the cascade encodes the listed keys. Level 2 encodes those keys of
the corpus's universe that level 1 takes in wrongly, level 3 the listed keys
that level 2 takes in, and so on until no key is taken wrongly. For every key of
the universe the depth at which a level first rejects it then tells exactly
whether it is listed: membership without a join.

Keys are host names: a page is listed if its host or a domain above it is. The
universe holds every host of the corpus and every domain above one. The list is
a table of keys (``listed``); by default it is made of the hosts that name one of
TERMS (``flagged``). Only the cascade carries it to the pages.

The levels' bits are the only thing that reaches the driver and the plan. They
are bounded: ``max_bits`` for a level, checked against the counted keys; a
longer list gets fewer bits a key and more levels, and a list too long even for
that (under ``MIN_BITS`` bits a key) is split by a hash of the key, each part
with a cascade of its own and a pass over the narrow table of pages.

Rules fit a host and its subdomains, with a path prefix; the longest fitting
rule (host, then path) wins over the cascade.

Defined cases: a null url or one without "://" has empty host and path, fits no
rule and is allowed; repeated rows are judged alike; null ids stay; listed keys
that are null, empty or over LONGEST characters (no host name is) list nothing;
urls of any length are judged whole; an empty list allows what no rule blocks;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ipaloom.llm import util
from ipaloom.llm.util import let

#: (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Parts of host labels that put a host on the default block list.
TERMS = ["ads", "adult", "bet", "bets", "casino", "pills", "porn", "spam", "viagra", "xxx"]
BITS_A_KEY = 10
MIN_BITS = 3
WORD = 63
#: Characters and labels of the longest host name.
LONGEST, LABELS = 253, 127


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_host(key: Column, terms: list[str] = TERMS) -> Column:
    """Whether a host has one of ``terms`` as a whole part of a label."""
    return key.rlike(rf"(?:^|[.-])(?:{'|'.join(terms)})(?:[.-]|$)")


def flagged(hosts: DataFrame, terms: list[str] = TERMS) -> DataFrame:
    """(key): the list of the ``hosts`` (key) that name one of ``terms``."""
    return hosts.where(listed_host(F.col("key"), terms))


def domains(host_: Column) -> Column:
    """A host and the domains above it, those that may be host names by their length."""
    labels = F.split(host_, r"\.")
    last = F.slice(labels, F.greatest(F.size(labels) - (LABELS - 1), F.lit(1)), F.lit(LABELS))
    return F.filter(F.transform(last, lambda _, i: F.array_join(F.slice(last, i + 1, F.lit(LABELS)), ".")), lambda d: (d != "") & (F.char_length(d) <= LONGEST))


def rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host + path, its verdict) of the longest fitting rule; nulls where none fits."""
    name = verdict = F.lit(None).cast("string")
    dotted = F.concat(F.lit("."), host_)
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = F.endswith(dotted, F.lit(f".{h}")) & F.startswith(path_, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


class Level:
    """One Bloom filter: words of 63 bits."""

    def __init__(self, bits: int, hashes: int, seed: int):
        self.bits, self.hashes, self.seed = bits, hashes, seed
        self.words: list[int] = []

    def _places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.seed * 100 + i), key), F.lit(self.bits)) for i in range(self.hashes)]

    def build(self, keys: DataFrame) -> "Level":
        """Set the bits of all keys; at most bits / 63 words reach the driver."""
        at = keys.select(F.explode(F.array(*self._places(F.col("key")))).alias("at"))
        words = at.groupBy((F.col("at") / WORD).cast("long").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(at % {WORD} as int))")).alias("bits"))
        self.words = [0] * (self.bits // WORD + 1)
        for r in words.collect():
            self.words[r["word"]] = r["bits"]
        return self

    def has(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<long>")  # folded to a literal
        test = None
        for at in self._places(key):
            bit = let(at, lambda a: F.getbit(words[(a / WORD).cast("int")], (a % WORD).cast("int")) == 1)
            test = bit if test is None else test & bit
        return test


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def has(self, key: Column) -> Column:
        """Listed, if the first level that rejects the key is an even one, or none and their number is odd."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].has(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def build_cascade(universe: DataFrame, bits_a_key: int = BITS_A_KEY, max_bits: int = 1 << 22) -> Cascade | None:
    """Cascade over ``universe`` (key, listed), one row a key; None where the list is too long for ``max_bits``."""
    return cascade_of(universe.where("listed").select("key"), universe.where("not listed").select("key"), bits_a_key, max_bits)


def cascade_of(listed: DataFrame, others: DataFrame, bits_a_key: int = BITS_A_KEY, max_bits: int = 1 << 22) -> Cascade | None:
    """Cascade that tells ``listed`` from ``others`` (key); what is in both is listed. None where a level would take over ``max_bits``."""
    levels: list[Level] = []
    mine = listed
    while True:
        n = mine.count()
        if not n:
            break
        each = min(bits_a_key, max_bits / n)
        if each < MIN_BITS:
            return None
        level = Level(max(1024, int(n * each)), max(1, round(each * math.log(2))), len(levels) + 1).build(mine)
        levels.append(level)
        taken = others.where(level.has(F.col("key")))
        if len(levels) == 1:  # few are left to be told apart by name
            taken = taken.join(listed, "key", "left_anti")
        mine, others = util.materialize(taken), mine
    return Cascade(levels)


def judge(pages: DataFrame, rules=RULES, terms: list[str] = TERMS, max_bits: int = 1 << 22, listed: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every page; ``listed``: (key) hosts and domains to block."""
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    hosts = util.materialize(rows.select(F.col("host").alias("key")).where("key != ''").distinct())
    universe = util.materialize(hosts.select(F.explode(domains(F.col("key"))).alias("key")).distinct())
    listed = flagged(hosts, terms) if listed is None else listed.select("key")
    listed = util.materialize(listed.where(F.col("key").isNotNull() & (F.col("key") != "") & (F.char_length("key") <= LONGEST)).distinct())
    parts = max(1, math.ceil(listed.count() * MIN_BITS * 1.2 / max_bits))
    found = F.lit(False)
    for i in range(parts):
        own = lambda c: F.pmod(F.xxhash64(F.lit(77), c), F.lit(parts)) == i if parts > 1 else F.lit(True)  # noqa: B023, E731
        cascade = cascade_of(listed.where(own(F.col("key"))), universe.where(own(F.col("key"))), max_bits=max_bits)
        if cascade is None:
            raise RuntimeError("a part of the list is too long")
        if not cascade.levels:
            continue
        hit = F.exists(domains(F.col("host")), lambda d: own(d) & cascade.has(d))  # noqa: B023
        if parts == 1:
            found = hit
        else:  # one part's bits at a time
            rows = util.materialize(rows.withColumn("listed", (F.col("listed") if "listed" in rows.columns else F.lit(False)) | hit))
            found = F.col("listed")
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("listed", found).withColumn("rule", name).withColumn("_rules", verdict)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("_rules", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed")


ORACLE_SQL = """
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(verdict, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT DISTINCT host, path,
         arg_max(h || p, length(h) + length(p)) AS rule,
         arg_max(verdict, length(h) + length(p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts), rules
  WHERE ends_with('.' || host, '.' || h) AND starts_with(path, p)
  GROUP BY host, path
), marked AS (
  SELECT *, regexp_matches(host, '(^|[.-])(ads|adult|bet|bets|casino|pills|porn|spam|viagra|xxx)([.-]|$)') AS listed FROM parts
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM marked LEFT JOIN fits USING (host, path)
"""
