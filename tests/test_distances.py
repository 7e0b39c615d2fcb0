import pytest
from pyspark.sql import functions as F

from ipaloom.functions import features as feat
from ipaloom.functions.distance import edit, normalised_edit
from ipaloom.operators import evaluate, pairs
from ipaloom.plans import queries as plans
from ipaloom.sources import dictionary
from ipaloom.sources.inventory import LanguageRegistry, intersect, phoneme_features, sort_features, universal_dict

REG = LanguageRegistry()
EN = REG["en"].features
WORDS = ["kæt", "kæb", "stɹɪŋ", "æt", "s", "ʌndɜ"]


def tokens(ipa):
    import re

    from ipaloom.functions.text import alternation

    return re.findall(alternation(EN), ipa)


def test_distance_is_the_plain_one(spark):
    d, enc = REG.build_distance("en"), feat.BitEncoder(REG["en"])
    rows = spark.createDataFrame([(a, b) for a in WORDS for b in WORDS], "a string, b string")
    got = rows.select("a", "b", d.hamming(F.col("a"), F.col("b")).alias("h"), d.edit_distance(F.col("a"), F.col("b")).alias("e"), d.normalised_edit_distance(F.col("a"), F.col("b")).alias("n")).collect()
    for r in got:
        x, y = enc.word(tokens(r["a"])), enc.word(tokens(r["b"]))
        assert r["h"] == pytest.approx(sum(p == q for p, q in zip(x, y)) / len(x))
        assert r["e"] == pytest.approx(edit(tokens(r["a"]), tokens(r["b"]), EN)) and r["n"] == pytest.approx(normalised_edit(tokens(r["a"]), tokens(r["b"]), EN))
    table = spark.createDataFrame([(w, w) for w in WORDS], "key string, ipa string")
    by = {(r["a"], r["b"]): r for r in got}
    for found, column in ((d.pairwise_hamming(table), "h"), (d.pairwise_edit_distance(table), "n"), (d.pairwise_edit_distance(table, False), "e")):
        assert {(r["a"], r["b"]): r["value"] for r in found.collect()} == {k: pytest.approx(r[column]) for k, r in by.items()}


def test_pairs_in_blocks(spark, monkeypatch):
    rows = spark.range(40).select(F.format_string("k%02d", "id").alias("key"), F.col("id").alias("x"))
    measure = lambda a, b: F.abs(a - b).cast("double")
    whole = sorted(map(tuple, pairs.pairwise(rows, measure, 0.0, ["x"]).collect()))
    monkeypatch.setattr(pairs, "LIMIT", 10)
    monkeypatch.setattr(pairs, "BLOCK", 7)
    assert sorted(map(tuple, pairs.pairwise(rows, measure, 0.0, ["x"]).collect())) == whole and len(whole) == 1600


def test_bits_of_words(spark):
    enc = feat.BitEncoder(REG["fr"])
    rows = [(["k", "a", "t"],), ([],), (["a"] * 3 + ["s", "o"] * 9,), (None,)]
    bits = feat.word_bits(F.col("t"), REG["fr"])
    got = spark.createDataFrame(rows, "t array<string>").select("t", bits.alias("b")).withColumn("f", feat.folded(F.col("b"), REG["fr"].syllable_bits)).collect()
    for r in got:
        if r["t"] is None:
            assert r["b"] is None
        else:
            assert r["b"] == enc.word(r["t"]) and r["f"] == enc.fold(r["b"])


def test_languages_pair_by_concept(spark):
    specs = {k: REG[k] for k in ("en", "fr", "de")}
    words = {("mother", "en"): ["m", "ʌ", "ð", "ɜ"], ("mother", "fr"): ["m", "ɛ", "ʁ"], ("mother", "de"): ["m", "ʊ", "t", "ə", "ʁ"], ("sun", "en"): ["s", "ʌ", "n"], ("sun", "de"): ["z", "o", "n", "ə"]}
    rows = spark.createDataFrame([(c, k, t) for (c, k), t in words.items()], "concept string, lang string, tokens array<string>")
    for metric in ("edit", "hamming"):
        got = {(r["concept"], r["lang_a"], r["lang_b"]): r["value"] for r in pairs.cross_language(rows, metric, specs).collect()}
        assert set(got) == {("mother", "de", "en"), ("mother", "de", "fr"), ("mother", "en", "fr"), ("sun", "de", "en")}
        for (c, a, b), value in got.items():
            x, y = words[c, a], words[c, b]
            if metric == "edit":
                want = normalised_edit(x, y, {p: universal_dict(p) for p in {*x, *y}})
            else:
                enc = feat.BitEncoder(intersect(specs[a], specs[b]))
                p, q = enc.word(x), enc.word(y)
                want = sum(i == j for i, j in zip(p, q)) / len(p)
            assert value == pytest.approx(want)
    with pytest.raises(ValueError):
        pairs.cross_language(rows, "cosine")


def test_recovery_takes_the_nearest(spark):
    seg = spark.createDataFrame([("p", ["u", "v"], 0.4), ("p", ["x"], 0.1), ("p", ["y"], 0.2)], "phrase string, words array<string>, distance double")
    want = spark.createDataFrame([("p", ["u", "v"])], "phrase string, expected array<string>")
    assert [evaluate.recovered(seg, want, n).first()["found"] for n in (2, 3)] == [False, True]


def test_features_by_name():
    assert list(sort_features({"b": 1, "a": 2})) == ["a", "b"] and phoneme_features(EN, "p")["manner"] == "plosive"
    with pytest.raises(KeyError):
        phoneme_features(EN, "?")
    spec = REG.build_spec("en")
    REG.clear_cache()
    assert REG.build_spec("en") == spec


def test_the_dictionary_is_made_once_and_plain(spark, tmp_path):
    docs = spark.createDataFrame([("fr", "Le chat, le CHAT é"), ("xx", "foo"), (None, "bar"), ("en", None), ("en", "")], "lang string, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    made = dictionary.prepared(spark, str(tmp_path / "documents.parquet"), plans.SPECS)
    got = {(r["lang"], r["word"]): (r["frequency"], r["prons"], r["tokens"], r["n_tok"]) for r in made.collect()}
    assert set(got) == {("fr", "le"), ("fr", "chat"), ("fr", "é"), ("xx", "foo")}
    assert got["fr", "chat"] == (2, "ʃat", ["ʃ", "a", "t"], 3) and got["xx", "foo"][:3] == (1, None, None)
    again = dictionary.prepared(spark, str(tmp_path / "documents.parquet"), plans.SPECS)
    assert again.inputFiles() == made.inputFiles()
    # a query over it has no expression on single occurrences of words left
    plan = plans.pretokenize(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "Aggregate" not in plan
    docs.write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    assert dictionary.prepared(spark, str(tmp_path / "documents.parquet"), plans.SPECS).where("word = 'chat'").first()["frequency"] == 4
