import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ipaloom.functions import coarticulation as co
from ipaloom.functions import distance as dist
from ipaloom.functions import features as feat
from ipaloom.functions import syllables as syl
from ipaloom.functions import text
from ipaloom.operators.pairs import compare_cross_language
from ipaloom.sources.inventory import LANGUAGES, LanguageRegistry, derive_columns, features, intersect, merge_inventories, universal, universal_dict

REG = LanguageRegistry()


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


def test_clean_and_marks(spark):
    raw = "ˈkæːt‿ˌé"
    assert one(spark, text.clean_phones(F.lit(raw))) == "kæté"
    assert one(spark, text.clean_phones(F.lit(raw), preserve_stress=True)) == "ˈkæt" + "ˌé"
    assert one(spark, text.clean_phones(F.lit(raw), config=text.PRESERVE_LENGTH)) == "kæːté"
    assert text.STRIP_ALL.strip_all and not text.PRESERVE_ALL.strip_all
    assert [tuple(m) for m in one(spark, text.stress_marks(F.lit("ˈkæˌt")))] == [(0, "primary"), (2, "secondary")]
    assert [tuple(m) for m in one(spark, text.stress_marks(F.lit("ˈˌa")))] == [(0, "primary"), (0, "secondary")]
    assert one(spark, text.stress_marks(F.lit(""))) == []


def test_tokens_are_longest_match_and_skip_unknown(spark):
    phones = ["t", "ʃ", "tʃ", "a"]
    assert one(spark, text.tokenize(F.lit("tʃa?tta"), phones)) == ["tʃ", "a", "t", "t", "a"]
    assert one(spark, text.tokenize(F.lit("a"), phones, 2)) == []
    assert one(spark, text.search_phoneme(F.lit("tʃa"), phones)) == "tʃ"
    assert one(spark, text.search_phoneme(F.lit("xa"), phones)) is None


def test_every_spelling_gives_known_phonemes():
    import re

    for lang, (_, rules) in LANGUAGES.items():
        for ipa in rules.values():
            assert "".join(re.findall(text.alternation(REG[lang].phones), ipa)) == ipa, (lang, ipa)


def test_inventories_are_complete():
    for lang in LANGUAGES:
        spec = REG[lang]
        for p, f in spec.features.items():
            assert f and any(universal(p)), p
            assert (universal_dict(p)["syl"] == 1) == (p in spec.vowels)
    assert universal("@") == (0,) * 24 and any(universal("é")) and universal("é") == universal("e")
    assert (universal_dict("p")["voi"], universal_dict("b")["voi"]) == (-1, 1)
    assert "en" in REG and "xx" not in REG and len(REG) == 4
    assert set(derive_columns({"a": {"high": True}, "t": {"voiced": False}, "ʰ": {"marker": True}}, {"a"})["modifier"]) == {"marker"}
    assert len(merge_inventories(REG["en"].features, REG["fr"].features)) == len({*REG["en"].features, *REG["fr"].features})


def test_feature_distance():
    assert feat.feature_distance(features("p"), features("b")) == pytest.approx(1 / 3)
    assert feat.feature_distance({}, {}) == 0 and feat.feature_distance({}, {"a": False}) == 1
    assert feat.universal_distance("p", "p") == 0 and 0 < feat.universal_distance("p", "a") <= 1


def brute(a, b, f, ins=1.0, dele=1.0):
    row = [j * ins for j in range(len(b) + 1)]
    for x in a:
        new = [row[0] + dele]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + dele, new[j] + ins, row[j] + feat.feature_distance(f.get(x, {}), f.get(y, {}))))
        row = new
    return row[-1]


def test_edit_distance_kernels_agree(spark):
    rng = random.Random(1)
    f = REG["en"].features
    names = sorted(f)
    index, matrix = feat.distance_matrix(f)
    pairs = [([rng.choice(names) for _ in range(rng.randint(0, 6))], [rng.choice(names) for _ in range(rng.randint(0, 6))]) for _ in range(40)]
    want = [brute(a, b, f) for a, b in pairs]
    assert [dist.edit(a, b, f) for a, b in pairs] == pytest.approx(want)
    assert dist.edit(["p"], ["p", "a", "t"], f, insert=0.5) == pytest.approx(brute(["p"], ["p", "a", "t"], f, 0.5))
    rows = spark.createDataFrame([(i, [index[t] for t in a], [index[t] for t in b]) for i, (a, b) in enumerate(pairs)], "i int, a array<int>, b array<int>")
    m = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in matrix])
    got = rows.select("i", dist.edit_distance(F.col("a"), F.col("b"), m).alias("d")).orderBy("i").collect()
    assert [r["d"] for r in got] == pytest.approx(want)
    assert dist.normalised_edit([], [], f) == 0
    for (a, b), d in itertools.islice(zip(pairs, want), 10):
        assert dist.edit(b, a, f) == pytest.approx(d)


def test_hamming(spark):
    assert one(spark, feat.hamming_distance(F.lit("0011"), F.lit("0101"))) == 2
    assert one(spark, feat.hamming_similarity(F.lit(""), F.lit(""))) == 1.0
    with pytest.raises(Exception):
        one(spark, feat.hamming_distance(F.lit("0"), F.lit("00")))


def test_bits():
    enc = feat.BitEncoder(REG["en"])
    s = enc.syllables(["k", "æ", "t"])
    assert len(s) == 1 and set(s[0]) == {"onset", "nucleus", "coda"}
    s = enc.syllables(["æ", "t", "æ"])
    assert "coda" not in s[0] and "onset" in s[1]
    assert enc.syllables(["t", "s"]) == []
    word = enc.word(["k", "æ", "t"], 2)
    assert len(word) == 2 * REG["en"].syllable_bits and enc.word(["t"], 1) == "0" * REG["en"].syllable_bits
    assert enc.fold(word) == word[: REG["en"].syllable_bits]
    assert feat.bits_of({"manner": "nasal", "voiced": True}, ("voiced", "manner=nasal", "nasal", "high")) == "1110"


def test_syllables(spark):
    vowels = {"a"}
    rank = lambda ts: [syl.sonority(t) for t in ts]
    cut = lambda ts, **k: ["".join(o + n + c) for o, n, c in syl.max_onset(ts, vowels, rank(ts), **k)]
    assert cut(list("astra")) == ["a", "stra"]
    assert cut(list("astra"), appendix=False) == ["as", "tra"]
    assert cut(list("alpa")) == ["al", "pa"] and cut(list("pst")) == ["pst"] and cut([]) == []
    assert [syl.sonority(p) for p in ("a", "j", "w", "l", "ɹ", "n", "s", "t", "@")] == [6, 5, 5, 4, 4, 3, 2, 1, 1]
    s = syl.syllabify(F.col("t"), vowels, F.array(F.struct(F.lit(2).alias("idx"), F.lit("primary").alias("kind"))))
    row = spark.createDataFrame([(list("papa"),)], "t array<string>").select(s.alias("s"))
    got = row.select(syl.stress_pattern(F.col("s")), syl.syllable_count(F.col("s")), syl.boundary_map(F.col("s")), syl.stressed_syllable(F.col("s"))["onset"]).first()
    assert tuple(got) == ("01", 2, [0, 0, 1, 1], ["p"])
    assert syl.assign_stress(syl.max_onset(list("papa"), vowels, rank("papa")), [(0, "secondary"), (1, "primary")]) == ["primary", None]


def test_coarticulation():
    at = co.AT
    raw = np.array([universal(t) for t in ("k", "i")], dtype=float)
    assert co.perturb(["t", "i"])[0, at["hi"]] == pytest.approx(-1 + 0.35)
    assert co.perturb(["t", "i"], [0, 1])[0, at["hi"]] == pytest.approx(-1 + 0.35 * 0.4)
    assert (co.perturb(["k", "i"], [0, 1], decay=0.0) == raw).all()
    assert co.perturb(["n", "a"])[1, at["nas"]] == pytest.approx(-0.5)
    assert (co.perturb(["n", "a"], jitter=0.5, seed=3) == co.perturb(["n", "a"], jitter=0.5, seed=3)).all()
    on = co.FricativeConfig(frication_spread=True)
    assert co.perturb(["s", "a"], fricative=on)[1, at["voi"]] == pytest.approx(1 - 1.6 * 0.30)
    assert co.perturb(["z", "a"], fricative=on)[1, at["voi"]] == 1
    assert np.abs(co.perturb(list("snkiuw"), jitter=1.0, seed=9)).max() <= 1
    ones = np.ones((1, 24))
    assert co.vector_costs(ones, -ones)[0, 0] == 1 and co.vector_costs(ones * 0, ones * 0)[0, 0] == 0
    with pytest.raises(ValueError):
        co.FricativeConfig(sibilant_weight=-1)
    with pytest.raises(ValueError):
        co.perturb(["a"], jitter=2)


def test_cross_language():
    specs = {k: REG[k] for k in ("en", "fr")}
    same = compare_cross_language({"en": "mama", "fr": "mama"}, specs)
    assert set(same) == {("en", "fr")}
    assert compare_cross_language({"en": "ki", "fr": "ki"}, specs, "hamming")["en", "fr"] == 1.0
    assert "+" in intersect(REG["en"], REG["fr"]).key
    with pytest.raises(ValueError):
        compare_cross_language({"en": "a", "fr": "a"}, specs, "cosine")
