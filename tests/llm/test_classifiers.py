"""op3, op8 and op10 by held-out accuracy."""

import numpy as np
from pyspark.sql import functions as F

from ipaloom.llm import langid, quality, queries, toxicity, util

SF = "/root/testdata/sf0.01"


def agreement(found, labels, column):
    rows = found.join(labels, "doc_id").where("held_out").select(F.col(column).alias("y"), F.col("predicted").alias("p")).collect()
    hits = sum(r["y"] == r["p"] for r in rows) / len(rows)
    recall = sum(r["p"] for r in rows if r["y"]) / max(1, sum(r["y"] for r in rows))
    return hits, recall


def test_quality(spark, docs, labels, odd, empty):
    hits, _ = agreement(queries.op3_quality(spark, SF), labels, "quality")
    assert hits > 0.97
    model = quality.fit(docs, labels, ~quality.held_out())
    got = quality.score(odd, model).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got) and quality.score(empty, model).count() == 0
    assert {r["score"] for r in got if r["doc_id"] in (1, 2, 3)} == {model.prior}
    assert quality.keep_good(odd, model).columns == odd.columns
    none = quality.fit(docs, labels.where("1 = 0"), ~quality.held_out())
    assert {r["score"] for r in quality.score(odd, none).collect()} == {0.5}


def test_toxicity(spark, docs, labels, odd, empty):
    hits, recall = agreement(queries.op8_toxicity(spark, SF), labels, "toxic")
    assert hits > 0.93 and recall > 0.7
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    got = toxicity.score(odd, model).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got) and toxicity.score(empty, model).count() == 0
    none = toxicity.fit(docs, labels.where("toxic = 0"), ~toxicity.held_out())
    assert {r["predicted"] for r in toxicity.score(odd, none).collect()} == {0}


def test_language(spark, docs, odd, empty):
    rows = queries.op10_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    model = langid.fit(docs, ~langid.held_out())
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert {got[i]["lang_pred"] for i in (1, 2, 3, 8)} == {"und"} and got[7]["lang_pred"] != "und" and len(got) == 9
    assert langid.identify(empty, model).count() == 0
    none = langid.fit(docs.where("1 = 0"), ~langid.held_out())
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}


def test_letters_beyond_the_basic_plane():
    got = langid.counts(["\U0001F600 12", "\U0001D49C\U0001D4B7", "\U0001F1E9\U0001F1EA"]).sum(axis=1)
    assert got[0] == got[2] == 0 and got[1] > 0


def test_toxicity_calibrates_groups_with_few_toxic_texts():
    # texts of a small group score lower, toxic or not, than those of the large one
    p = np.concatenate([np.linspace(0.7, 0.9, 200), np.linspace(0.3, 0.5, 800), np.linspace(0.4, 0.5, 30), np.linspace(0.1, 0.2, 120)])
    y = np.concatenate([np.ones(200), np.zeros(800), np.ones(30), np.zeros(120)]).astype(np.float32)
    near = np.repeat([0, 1], [1000, 150])
    large, small = toxicity._thresholds(p, y, near, 2)
    assert 0.5 < large <= 0.7 and small < large
    assert (p[near == 1] >= small).sum() == 30
    # no own toxic text: the overall threshold still holds; a few pull less than many
    assert abs(toxicity._thresholds(p, y, np.where(y == 1, 0, near), 2)[1] - toxicity._best_threshold(p, y)) < 0.25


def test_toxicity_clusters_find_a_small_language():
    rng = np.random.default_rng(0)
    texts = [rng.integers(k * 20, k * 20 + 20, 60) for k in rng.choice(4, 2000, p=[0.9, 0.05, 0.03, 0.02])]
    lang = np.array([t[0] // 20 for t in texts])
    x = toxicity.profile(texts, np.arange(80))
    near = (x @ toxicity._clusters(x, 6).T).argmax(axis=1)
    for k in range(6):
        assert len(set(lang[near == k])) <= 1
    assert not len(toxicity._clusters(np.zeros((5, 3), np.float32), 6)) > 1


def test_text_without_white_space_is_read_to_its_end():
    start = ",".join(["word"] * 30)
    buckets = lambda t: set(toxicity.parts(t)[:, 0].tolist())
    assert buckets("Vile") < buckets(start + ",vile") and not buckets("vile") & buckets(start)
    for tail in ("_vile/x", "\u6f22" * 200, "a1B2" * 100):
        assert buckets(start) < buckets(start + tail)
        assert (quality.counts(start) != quality.counts(start + tail)).any()
    blob, other = "x" * 64 + "y" * 64, "x" * 64 + "z" * 64
    assert buckets(blob) != buckets(other) and (quality.counts(blob) != quality.counts(other)).any()
    text = start + "\u00e9\u6f22-=" * 50 + " a b"
    assert "".join(util.pieces(text)) == text.replace(" ", "") and max(map(len, util.pieces(text))) <= util.LONG
    assert util.pieces("a " + "b-" * 32) == ["a", "b-" * 32]
