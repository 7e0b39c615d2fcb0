import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from ipaloom.functions.distance import normalised_edit
from ipaloom.functions.features import distance_matrix
from ipaloom.operators import beam, entropy, evaluate, g2p, invert, scan
from ipaloom.sources import dictionary
from ipaloom.sources.inventory import LanguageRegistry
from ipaloom.streaming import enrich

REG = LanguageRegistry()
EN = REG["en"].features
WORDS = [("kat", "kæt"), ("bat", "bæt"), ("sat", "sæt"), ("kab", "kæb"), ("sun", "sʌn"), ("at", "æt"), ("dog", "dɔɡ"), ("satkat", "sætkæt")]


@pytest.fixture(scope="module")
def entries(spark):
    raw = spark.createDataFrame([("en", w, ipa + ", x") for w, ipa in WORDS], "lang string, word string, prons string")
    return dictionary.pretokenize(raw, {"en": REG["en"]}).cache()


def tokens(ipa):
    return tuple(c for c in ipa)


def test_scan_is_brute_force(entries):
    phrases = [scan.Phrase(k, tokens(k)) for k in ("kæt", "ɡæt", "sʌm", "")]
    got = {(r["phrase"], r["word"]): r["distance"] for r in scan.scan(phrases, entries, EN, 10, 0.5, overlap=0.0).collect()}
    want = {}
    for p in phrases:
        for w, ipa in WORDS:
            n, m = len(p.tokens), len(ipa)
            if n and max(n, m) <= 2 * min(n, m) and (d := normalised_edit(p.tokens, tokens(ipa), EN)) <= 0.5:
                want[p.key, w] = pytest.approx(round(d, 6))
    assert got == want
    top = scan.scan(phrases[:1], entries, EN, 2, 0.5).orderBy("distance", "word").collect()
    assert [r["word"] for r in top][0] == "kat" and len(top) == 2
    # no shared phoneme: the overlap filter rejects it
    assert not scan.scan([scan.Phrase("x", ("b", "æ", "t"))], entries.where("word = 'sun'"), EN, 5, 1.0).collect()


def test_beam_is_exhaustive_search_on_a_small_dictionary():
    entries = [(w, ipa, list(ipa)) for w, ipa in WORDS]
    config = beam.BeamConfig(beam_width=10_000, top_k=5, max_words=2, prune_ratio=1e9)
    source = list("kætsæt")
    found = beam.segment(source, entries, EN, config)
    assert found[0][0] == ["kat", "sat"] and found[0][2] == 0
    best = min(normalised_edit(source, [*a[2], *b[2]], EN) for a, b in itertools.product(entries, entries))
    assert found[0][2] == pytest.approx(best)
    assert [f[2] for f in found] == sorted(f[2] for f in found) and len({tuple(f[0]) for f in found}) == len(found)
    assert beam.segment([], entries, EN, config) == [] and beam.segment(source, [], EN, config) == []
    tight = {tuple(f[0]) for f in beam.segment(source, entries, EN, beam.BeamConfig(max_distance=0.1, max_words=2))}
    assert tight <= {tuple(f[0]) for f in beam.segment(source, entries, EN, beam.BeamConfig(max_distance=0.5, max_words=2, top_k=50))}


def test_beam_in_spark(entries):
    got = beam.best(beam.segment_phrases([scan.Phrase("a", tokens("kætsæt")), scan.Phrase("b", ())], entries, EN)).collect()
    assert [(r["phrase"], r["words"], r["distance"]) for r in got] == [("a", ["satkat"], got[0]["distance"])] or got[0]["words"] == ["kat", "sat"]


def test_inversion(spark):
    found = invert.invert(EN["p"], EN, top_n=3)
    assert found[0] == ("p", 0.0) and len(found) == 3
    assert len(invert.invert(EN["p"], EN)) == len(EN) and not invert.invert(EN["p"], {"a": EN["ɑ"]}, max_distance=0.1)
    rows = spark.createDataFrame([("k", ["p", "?"])], "key string, tokens array<string>")
    got = invert.invert_ipa(rows, EN, EN, 1).orderBy("pos").collect()
    assert got[0]["matches"][0]["phoneme"] == "p" and got[1]["matches"] is None


def test_dictionary_files(spark, tmp_path):
    path = tmp_path / "en.tsv"
    path.write_text("Cat \tˈkæt, kɛt\ndog\tdɔɡ\nbad\tQNOU\nalone\ndog\tdɑɡ\n")
    raw = dictionary.read_tsv(spark, str(path), "en")
    assert {(r["word"], r["prons"]) for r in raw.collect()} == {("cat", "ˈkæt, kɛt"), ("dog", "dɑɡ")}
    assert dictionary.read_tsv(spark, str(tmp_path / "none.tsv"), "en").count() == 0
    assert dictionary.variants(raw).where("word = 'cat'").count() == 2
    specs = {"en": REG["en"]}
    key = dictionary.fingerprint(raw, specs, 2)
    assert key != dictionary.fingerprint(raw.where("word = 'cat'"), specs, 2)
    made = dictionary.cached(spark, lambda: raw, specs, str(tmp_path / "c"), key)
    assert made.where("word = 'cat'").first()["ipa"] == "kæt"

    def fail():
        raise AssertionError("a hit must not call the factory")

    assert dictionary.cached(spark, fail, specs, str(tmp_path / "c"), key).count() == 2
    with pytest.raises(ValueError):
        dictionary.load(spark, str(tmp_path / "nothing"))
    assert dictionary.inventory_of(made) == sorted({"k", "æ", "t", "d", "ɑ", "ɡ"})


def test_entropy(spark):
    rows = spark.createDataFrame([("x", "c", str(i), 5) for i in range(4)], "lang string, component string, pattern string, n long")
    assert entropy.entropy(rows).first()["entropy"] == pytest.approx(2.0)
    words = spark.createDataFrame([("x", [("1", "0", None)], 3), ("x", [("0", "1", "1")], 1)], "lang string, syllables array<struct<onset:string,nucleus:string,coda:string>>, frequency long")
    got = {r["component"]: r for r in entropy.metrics(words, 1, 1).collect()}
    h = -(0.75 * np.log2(0.75) + 0.25 * np.log2(0.25))
    assert got["onset"]["entropy"] == pytest.approx(h) and got["coda"]["entropy"] == pytest.approx(0) and got["joint"]["entropy"] == pytest.approx(h)
    assert got["onset"]["utilisation"] == 1.0 and got["onset"]["provision"] == "under"
    assert got["joint"]["redundancy"] == pytest.approx(h)
    assert entropy.top_patterns(entropy.pattern_counts(words), 1).count() == 4


def test_g2p(spark):
    words = spark.createDataFrame([("fr", "eau"), ("fr", "chat")], "lang string, word string")
    known = spark.createDataFrame([("fr", "eau", "O")], "lang string, word string, prons string")
    got = {r["word"]: r["prons"] for r in g2p.phones_for(words, known).collect()}
    assert got == {"eau": "O", "chat": "ʃat"}
    with pytest.raises(Exception):
        g2p.phones_for(words, known, g2p.Resource.DICTIONARY).collect()
    with pytest.raises(g2p.ResearchUseOnlyError):
        g2p.generate(words, lambda: None, research_use=False)
    with pytest.raises(ValueError):
        g2p.generate(words, lambda: None, batch_size=0, research_use=True)
    model = lambda: lambda prompts: ([p.upper() for p in prompts], [None] * len(prompts))
    assert {r["prons"] for r in g2p.generate(words, model, research_use=True).collect()} == {"<FR>: EAU", "<FR>: CHAT"}


def test_evaluation(spark):
    pairs = spark.createDataFrame([("l", "a", "b"), ("m", "a", "zz")], "label string, word_a string, word_b string")
    variants = spark.createDataFrame([("a", "x"), ("a", "xy"), ("b", "xyz")], "word string, ipa string")
    found = evaluate.best_variants(pairs, variants, lambda a, b: (F.char_length(b) - F.char_length(a)).cast("double"))
    got = {r["label"]: (r["distance"], r["ipa_a"]) for r in found.collect()}
    assert got["l"] == (1.0, "xy") and got["m"][0] is None
    assert tuple(evaluate.recall(found, 1.0).first()) == (2, 1, 1, 0.5)
    seg = spark.createDataFrame([("p", ["u", "v"]), ("q", ["u"])], "phrase string, words array<string>")
    want = spark.createDataFrame([("p", ["u", "v", "w"]), ("q", ["z"])], "phrase string, expected array<string>")
    assert {(r[0], r[1]) for r in evaluate.recovered(seg, want).collect()} == {("p", True), ("q", False)}
    assert evaluate.mined(seg).count() == 1


def test_stream(spark, tmp_path):
    spark.createDataFrame([("thin",)], "w string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("w string").parquet(str(tmp_path / "in"))
    q = enrich.transcribed(stream, "w").writeStream.format("memory").queryName("enriched").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert spark.table("enriched").first()["tokens"] == ["θ", "ɪ", "n"]


def test_matrix_unknowns():
    index, m = distance_matrix({"a": {"x": True}}, ["?", "!", "a"])
    assert m[index["?"], index["!"]] == 0 and m[index["?"], index["a"]] == 1
