"""Named queries over the driver's tables, and DuckDB statements that give the same rows.

Words of ``documents`` are spelled out by rule, which makes a dictionary for each
language; the distinct names in ``part`` are the phrases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ipaloom.functions import coarticulation, distance, syllables, text
from ipaloom.functions import features as feat
from ipaloom.operators import beam, entropy, evaluate, g2p, invert, pairs
from ipaloom.operators import scan as scan_op
from ipaloom.session import ship
from ipaloom.sources import dictionary
from ipaloom.sources.inventory import CONSONANTS, LANGUAGES, NASAL_VOWELS, VOWELS, LanguageRegistry, inventory_table, universal, universal_table
from ipaloom.streaming import enrich

REGISTRY = LanguageRegistry()
SPECS = {k: REGISTRY[k] for k in LANGUAGES}
TARGETS = ("de", "es", "fr")
#: Features of all languages' phonemes; a phoneme has the same ones in each.
FEATURES = {p: f for k in SPECS for p, f in SPECS[k].features.items()}
NAMES = sorted(FEATURES)
INDEX, MATRIX = feat.distance_matrix({p: FEATURES[p] for p in NAMES})
MAX_DISTANCE = 0.5
TOP = 10


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.prepared(spark, f"{sf_dir}/documents.parquet", SPECS)


def _entries(spark: SparkSession, sf_dir: str, langs=tuple(LANGUAGES), min_length: int = 3, min_tokens: int = 2) -> DataFrame:
    rows = _prepared(spark, sf_dir).where(F.col("lang").isin(*langs) & (F.col("n_tok") >= min_tokens) & (F.char_length("word") >= min_length))
    return rows.select("lang", "word", "ipa", "tokens", "n_tok", "frequency")


def _phrase_rows(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    """(phrase, ipa, tokens): the distinct names of parts, or their single words."""
    name = F.lower("p_name")
    names = _read(spark, sf_dir, "part").select((F.explode(F.split(name, " ")) if split else name).alias("phrase")).where("phrase is not null").distinct()
    rows = names.withColumn("ipa", text.spell(F.col("phrase"), LANGUAGES["en"][1]))
    return rows.withColumn("tokens", text.tokenize(F.col("ipa"), SPECS["en"].phones)).where(F.size("tokens") > 0)


def _phrases(spark: SparkSession, sf_dir: str, split: bool = True) -> list[scan_op.Phrase]:
    """The distinct phrases, which are the stated query set."""
    return [scan_op.Phrase(r["phrase"], tuple(r["tokens"])) for r in _phrase_rows(spark, sf_dir, split).orderBy("phrase").collect()]


def reverse_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each phrase the ten nearest French words."""
    return scan_op.scan(_phrases(spark, sf_dir), _entries(spark, sf_dir, ("fr",)), FEATURES, TOP, MAX_DISTANCE)


def multi_language_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each phrase and target language the nearest word."""
    return scan_op.scan(_phrases(spark, sf_dir), _entries(spark, sf_dir, TARGETS), FEATURES, 1, MAX_DISTANCE)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).where("char_length(word) >= 3").select("lang", "word")


def g2p_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).where("char_length(word) >= 3 and prons != ''").select("lang", "word", "prons")


def g2p_dictionary_or_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark by a French dictionary whose entries differ from the rules (marked as stressed), by rule where it lacks them."""
    items = _read(spark, sf_dir, "benchmark").select(F.lit("fr").alias("lang"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(dictionary.LETTERS), F.lit(0))).alias("word")).distinct()
    raw = g2p_rules(spark, sf_dir).where("lang = 'fr'").withColumn("prons", F.concat(F.lit("ˈ"), "prons"))
    return g2p.phones_for(items, raw).where("prons != ''")


def pretokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("lang", "word", "ipa", F.array_join("tokens", " ").alias("tokens"), F.col("n_tok").cast("long").alias("n_tok"))


#: Precomposed letters and their decompositions, and the marks that cleaning knows: they stand where a word's length says.
_COMPOSED, _DECOMPOSED, _MARKS = ("é", "ã", "ü", "ﬁ"), ("e\u0301", "a\u0303", "u\u0308", "fi"), ("ˈ", "ˌ", "ː", "ˑ", "‿")


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, word, raw): transcriptions with a mark or two adjacent ones at a place, and a letter at the end, that vary with the word."""
    n, size = F.char_length("word"), F.char_length("prons")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    at = (n * 7 + F.ascii("word")) % (size + 1)
    raw = F.concat(F.substr("prons", F.lit(1), at), pick(_MARKS, n + F.ascii("word")), F.when(n % 3 == 0, pick(_MARKS, n)).otherwise(F.lit("")), F.substr("prons", at + 1), pick(_COMPOSED, n + size))
    return g2p_rules(spark, sf_dir).select("lang", "word", raw.alias("raw"))


def clean_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select(
        "lang", "word", text.clean_phones(F.col("raw")).alias("clean"), text.clean_phones(F.col("raw"), preserve_stress=True).alias("with_stress"),
        text.clean_phones(F.col("raw"), config=text.PRESERVE_LENGTH).alias("with_length"),
    )


def stress_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stress marks at places that vary, found again."""
    found = text.stress_marks(F.col("raw"))
    return _marked(spark, sf_dir).select("lang", "word", F.array_join(F.transform(found, lambda m: F.concat_ws(":", m["idx"], m["kind"])), ",").alias("marks"))


def phoneme_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = inventory_table(spark)
    a, b = inv.select("lang", F.col("phoneme").alias("a"), F.col("features").alias("fa")), inv.select("lang", F.col("phoneme").alias("b"), F.col("features").alias("fb"))
    return a.join(b, "lang").select("lang", "a", "b", F.round(feat.map_distance(F.col("fa"), F.col("fb")), 6).alias("distance"))


def universal_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = universal_table(spark)
    a, b = t.select(F.lit(1).alias("k"), F.col("phoneme").alias("a"), F.col("vec").alias("x")), t.select(F.lit(1).alias("k"), F.col("phoneme").alias("b"), F.col("vec").alias("y"))
    return a.join(F.broadcast(b), "k").select("a", "b", F.round(feat.vector_distance(F.col("x"), F.col("y")), 6).alias("distance"))


def invert_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(lang, p, q, round(d, 6)) for lang in TARGETS for p, f in sorted(SPECS["en"].features.items()) for q, d in invert.invert(f, SPECS[lang].features, 0, 0.6)]
    return spark.createDataFrame(rows, "lang string, phoneme string, match string, distance double")


def invert_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each phrase's phonemes with their nearest French ones."""
    rows = _phrase_rows(spark, sf_dir).select(F.col("phrase").alias("key"), "tokens")
    out = invert.invert_ipa(rows, SPECS["en"].features, SPECS["fr"].features, 0, 0.34)
    return out.select(F.col("key").alias("phrase"), F.col("pos").cast("long").alias("pos"), "token", F.array_join(F.array_sort(F.transform("matches", lambda m: m["phoneme"])), " ").alias("matches"))


def phrase_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised edit distances of all pairs of phrases, as column expressions alone."""
    table = F.create_map(*[F.lit(x) for p, i in INDEX.items() for x in (p, i)])
    rows = _phrase_rows(spark, sf_dir).select(F.col("phrase").alias("key"), F.transform("tokens", lambda t: table[t]).alias("ids"))
    matrix = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in MATRIX])
    measure = lambda a, b: F.round(distance.normalised(distance.edit_distance(a, b, matrix), a, b), 6)
    return pairs.pairwise(rows, measure, 0.0, ["ids"])


def word_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit vectors of all words, and all their slots in one."""
    rows = _entries(spark, sf_dir)
    bits = F.lit(None).cast("string")
    for k, spec in SPECS.items():
        bits = F.when(F.col("lang") == k, feat.word_bits(F.col("tokens"), spec)).otherwise(bits)
    rows = rows.select("lang", "word", bits.alias("bits"))
    return rows.withColumn("folded", feat.folded(F.col("bits"), SPECS["en"].syllable_bits))


def phrase_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hamming similarity of all pairs of phrases' bit vectors."""
    rows = _phrase_rows(spark, sf_dir).select(F.col("phrase").alias("key"), "ipa")
    return pairs.Distance(SPECS["en"]).pairwise_hamming(rows).withColumn("value", F.round("value", 6))


def cross_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the parts' names, spelled by each language's rules: distances of every two languages."""
    word = _phrase_rows(spark, sf_dir, True).select(F.col("phrase").alias("concept"))
    rows = None
    for k, spec in SPECS.items():
        own = word.select("concept", F.lit(k).alias("lang"), text.tokenize(text.spell(F.col("concept"), LANGUAGES[k][1]), spec.phones).alias("tokens"))
        rows = own if rows is None else rows.union(own)
    return pairs.cross_language(rows.where(F.size("tokens") > 0)).withColumn("value", F.round("value", 6))


def sign_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hamming similarity of embeddings' sign bits: every hundredth vector against all, five nearest."""
    bits = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    rows = _read(spark, sf_dir, "embeddings").select("vec_id", bits.alias("bits"))
    half = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.conv(F.substr("bits", i * 32 + 1, F.lit(32)), 2, 10).cast("long"))
    rows = rows.select("vec_id", F.char_length("bits").alias("n"), half.alias("w"))
    queries = F.broadcast(rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("w").alias("q"), F.col("n").alias("m")))
    d = sum(F.bit_count(F.col("w")[i].bitwiseXOR(F.col("q")[i])) for i in range(2))
    found = rows.join(queries, (F.col("n") == F.col("m")) & (F.col("vec_id") != F.col("query"))).select("query", "vec_id", F.round(1 - d / F.col("n"), 6).alias("similarity"))
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where("rank <= 5").withColumn("rank", F.col("rank").cast("long"))


def sonority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("lang", "word", F.array_join(syllables.ranks(F.col("tokens"), NAMES), "").alias("ranks"))


def syllabification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal-onset syllables of all words, stress on the first."""
    vowels = {p for k in SPECS for p in SPECS[k].vowels}
    marks = F.array(F.struct(F.lit(0).alias("idx"), F.lit("primary").alias("kind")))
    rows = _entries(spark, sf_dir).withColumn("s", syllables.syllabify(F.col("tokens"), vowels, marks))
    part = lambda x: F.concat_ws(".", *[F.array_join(x[c], "") for c in ("onset", "nucleus", "coda")])
    return rows.select("lang", "word", syllables.syllable_count(F.col("s")).alias("n"), syllables.stress_pattern(F.col("s")).alias("pattern"), F.array_join(F.transform("s", part), "|").alias("syllables"))


def phoneme_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _entries(spark, sf_dir).select("lang", F.explode("tokens").alias("pattern")).groupBy("lang", "pattern").agg(F.count("*").alias("n")).withColumn("component", F.lit("phoneme"))
    return entropy.entropy(counts).withColumn("entropy", F.round("entropy", 6))


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, word, syllables, frequency) of every word of any length."""
    encoders = {k: feat.BitEncoder(s) for k, s in SPECS.items()}

    @F.pandas_udf("array<struct<onset:string,nucleus:string,coda:string>>")
    def encode(lang, tokens):
        import pandas as pd

        return pd.Series([[{k: s.get(k) for k in ("onset", "nucleus", "coda")} for s in encoders[a].syllables(list(t))] for a, t in zip(lang, tokens)])

    return _entries(spark, sf_dir, min_length=1, min_tokens=1).select("lang", "word", encode("lang", "tokens").alias("syllables"), "frequency")


def entropy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = SPECS["en"]
    rows = entropy.metrics(_encoded(spark, sf_dir), len(spec.consonant_columns), len(spec.vowel_columns))
    return rows.select("lang", "component", "n_patterns", "total", "provision", *[F.round(c, 6).alias(c) for c in ("entropy", "redundancy")], F.round("utilisation", 12).alias("utilisation"))


def top_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy.top_patterns(entropy.pattern_counts(_encoded(spark, sf_dir)), 20).withColumn("rank", F.col("rank").cast("long"))


def segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases as up to three French words of any length with two phonemes or more."""
    return beam.segment_phrases(_phrases(spark, sf_dir, False), _entries(spark, sf_dir, ("fr",), min_length=1), FEATURES, beam.BeamConfig(max_words=3, top_k=3))


def recovered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the scan: phrases whose nearest word in each language lies within the threshold."""
    found = multi_language_scan(spark, sf_dir).groupBy("phrase").agg(F.min("distance").alias("distance"))
    every = _phrase_rows(spark, sf_dir, True).select("phrase").join(found, "phrase", "left").select(F.col("phrase").alias("label"), "distance")
    return evaluate.recall(every, 0.3).select(F.col("n"), F.col("hits").cast("long").alias("hits"), F.col("missing").cast("long").alias("missing"), F.round("recall", 6).alias("recall"))


def coarticulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of phrases to each other on co-articulated features."""
    rows = _phrase_rows(spark, sf_dir).select(F.col("phrase").alias("key"), "tokens")
    return pairs.pairwise(rows, lambda a, b: F.round(coarticulation.coarticulated_distance(a, b), 6), 0.0, ["tokens"])


def enriched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.transcribed(_read(spark, sf_dir, "events").select("event_id", "event_type"), "event_type").select("event_id", "ipa", F.size("tokens").cast("long").alias("n_tok"))


QUERIES = {
    f.__name__: f
    for f in (
        reverse_lookup, multi_language_scan, words, g2p_rules, g2p_dictionary_or_rules, pretokenize, clean_phones, stress_marks, phoneme_distances, universal_distances, invert_features, invert_phrases,
        phrase_distances, word_bits, phrase_hamming, cross_language, sign_bit_neighbours, sonority, syllabification, phoneme_entropy, entropy_metrics, top_patterns, segmentation, recovered_words, coarticulated, enriched_events,
    )
}


# The same in SQL. Tables of phonemes become literals; the arithmetic is written anew.


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _map(d: dict) -> str:
    return "MAP {" + ", ".join(f"{_q(k)}: {_q(v) if isinstance(v, str) else v}" for k, v in d.items()) + "}"


def _spelled(word: str, lang: str) -> str:
    rules = LANGUAGES[lang][1]
    return f"array_to_string(list_transform(regexp_extract_all({word}, {_q(text.alternation(rules))}), lambda g: ({_map(rules)})[g]), '')"


def _words_sql(langs=tuple(LANGUAGES), min_length: int = 3, min_tokens: int = 2) -> str:
    return f"""words AS (
  SELECT lang, word, count(*) AS frequency FROM (SELECT lang, unnest(regexp_extract_all(lower(text), {_q(dictionary.LETTERS)})) AS word FROM documents WHERE lang IN ({', '.join(map(_q, langs))})) WHERE length(word) >= {min_length} GROUP BY lang, word
), raw AS (
  SELECT * FROM (SELECT lang, word, frequency, CASE lang {' '.join(f'WHEN {_q(k)} THEN {_spelled("word", k)}' for k in langs)} END AS prons FROM words) WHERE prons <> ''
), entries AS MATERIALIZED (
  SELECT lang, word, ipa, tokens, len(tokens) AS n_tok, frequency FROM (
    SELECT lang, word, frequency, prons AS ipa, CASE lang {' '.join(f'WHEN {_q(k)} THEN regexp_extract_all(prons, {_q(text.alternation(SPECS[k].phones))})' for k in langs)} END AS tokens FROM raw) WHERE len(tokens) >= {min_tokens}
)"""


def _phrases_sql(split: bool = False) -> str:
    name = "unnest(string_split(lower(p_name), ' '))" if split else "lower(p_name)"
    return f"""phrases AS MATERIALIZED (
  SELECT phrase, tokens FROM (SELECT phrase, regexp_extract_all({_spelled('phrase', 'en')}, {_q(text.alternation(SPECS['en'].phones))}) AS tokens FROM (SELECT DISTINCT {name} AS phrase FROM part WHERE p_name IS NOT NULL)) WHERE len(tokens) > 0
)"""


def _ids(tokens: str) -> str:
    return f"list_transform({tokens}, lambda t: ({_map({p: i + 1 for p, i in INDEX.items()})})[t])"


def _matrix_sql() -> str:
    return "matrix AS (SELECT [" + ", ".join("[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in r) + "]" for r in MATRIX) + "] AS m)"


_EDIT = """list_reduce(a, lambda prev, x: list_reduce(list_transform(range(1, len(b) + 1), lambda j: j::DOUBLE), lambda row, j: list_append(row, least(row[len(row)] + 1, prev[len(row) + 1] + 1, prev[len(row)] + m[x::BIGINT][b[len(row)]])), [prev[1] + 1]), list_transform(range(0, len(b) + 1), lambda j: j::DOUBLE))[len(b) + 1]"""


def _scan_sql(langs, top: int) -> str:
    return f"""WITH {_words_sql(langs)}, {_phrases_sql(True)}, {_matrix_sql()},
e AS MATERIALIZED (SELECT lang, word, ipa, tokens, list_distinct(tokens) AS kinds, {_ids('tokens')} AS b FROM entries),
p AS MATERIALIZED (SELECT phrase, tokens, list_distinct(tokens) AS kinds, list_transform({_ids('tokens')}, lambda x: x::DOUBLE) AS a FROM phrases),
pairs AS MATERIALIZED (
  SELECT phrase, lang, word, ipa, a, b, m FROM p, e, matrix
  WHERE greatest(len(a), len(b)) <= 2 * least(len(a), len(b))
    AND abs(len(a) - len(b)) <= {MAX_DISTANCE}::DOUBLE * greatest(len(a), len(b)) + 1e-9
    AND len(list_intersect(p.kinds, e.kinds)) >= 0.2::DOUBLE * least(len(p.kinds), len(e.kinds)) - 1e-12
), d AS (
  SELECT phrase, lang, word, ipa, {_EDIT} / greatest(len(a), len(b)) AS distance FROM pairs
), r AS (
  SELECT phrase, lang, word, ipa, round(distance, 6) AS distance FROM d WHERE distance <= {MAX_DISTANCE}::DOUBLE + 1e-12
), best AS (
  SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY phrase, lang ORDER BY distance, word, ipa) <= {top}
)
"""


#: Runs of vowels number the syllables; of the consonants between two, those behind the last place without a rise in rank begin the second.
_SYLLABLES = """, t AS (
  SELECT lang, word, pos, tok, ({ranks})[tok] AS rank, tok IN ({vowels}) AS v FROM (SELECT lang, word, unnest(tokens) AS tok, unnest(range(1, len(tokens) + 1)) AS pos FROM entries)
), s AS (
  SELECT *, v AND NOT coalesce(lag(v) OVER w, false) AS opens FROM t WINDOW w AS (PARTITION BY lang, word ORDER BY pos)
), k AS (
  SELECT *, sum(opens::INT) OVER (PARTITION BY lang, word ORDER BY pos) AS k FROM s
), r AS (
  SELECT lang, word, k, list(tok ORDER BY pos) FILTER (v) AS nucleus, coalesce(list(tok ORDER BY pos) FILTER (NOT v), []) AS cluster, coalesce(list(rank ORDER BY pos) FILTER (NOT v), []) AS ranks FROM k GROUP BY lang, word, k
), c AS (
  SELECT *, max(k) OVER (PARTITION BY lang, word) AS last, CASE WHEN len(ranks) <= 1 THEN 1 ELSE coalesce(list_max(list_filter(range(2, len(ranks) + 1), lambda i: ranks[i-1] >= ranks[i])), 1) END AS cut FROM r
), d AS (
  SELECT *, CASE WHEN len(ranks) > 1 AND cut > 1 AND ranks[cut-1] = 2 AND ranks[cut] = 1 THEN cut - 1 ELSE cut END AS cut_at FROM c
), p AS (
  SELECT lang, word, k, last, nucleus, CASE WHEN k = last THEN cluster ELSE list_slice(cluster, 1, cut_at - 1) END AS coda, CASE WHEN k = last THEN [] ELSE list_slice(cluster, cut_at, len(cluster)) END AS next_onset FROM d
), q AS (
  SELECT *, coalesce(lag(CASE WHEN k = 0 THEN list_concat(coda, next_onset) ELSE next_onset END) OVER (PARTITION BY lang, word ORDER BY k), []) AS onset FROM p
)
SELECT lang, word, count(*)::INT AS n, '1' || repeat('0', count(*)::INT - 1) AS pattern,
       string_agg(CASE WHEN last = 0 THEN array_to_string(coda, '') || '..' ELSE array_to_string(onset, '') || '.' || array_to_string(nucleus, '') || '.' || array_to_string(coda, '') END, '|' ORDER BY k) AS syllables
FROM q WHERE k > 0 OR last = 0 GROUP BY lang, word"""

#: Syllables as bits: consonants before a run of vowels or'ed, the vowels or'ed, and the last consonants.
_ENCODED = """WITH {words}, f(lang, tok, v, cons, vow) AS (VALUES {bits}), t AS (
  SELECT e.lang, word, frequency, pos, e.tok, coalesce(f.v, 0) = 1 AS v, coalesce(cons, 0) AS cons, coalesce(vow, 0) AS vow FROM (SELECT lang, word, frequency, unnest(tokens) AS tok, unnest(range(1, len(tokens) + 1)) AS pos FROM entries) e LEFT JOIN f ON f.lang = e.lang AND f.tok = e.tok
), s AS (
  SELECT *, v AND NOT coalesce(lag(v) OVER (PARTITION BY lang, word ORDER BY pos), false) AS opens FROM t
), k AS (
  SELECT *, sum(opens::INT) OVER (PARTITION BY lang, word ORDER BY pos) + CASE WHEN v THEN 0 ELSE 1 END AS k, sum(opens::INT) OVER (PARTITION BY lang, word) AS runs FROM s
), g AS (
  SELECT lang, word, any_value(frequency) AS frequency, any_value(runs) AS runs, k, coalesce(bit_or(cons) FILTER (NOT v), 0) AS cons, coalesce(bit_or(vow) FILTER (v), 0) AS vow FROM k GROUP BY lang, word, k
), y AS (
  SELECT a.*, coalesce(b.cons, 0) AS coda FROM g a LEFT JOIN g b ON a.lang = b.lang AND a.word = b.word AND a.k = a.runs AND b.k = a.runs + 1 WHERE a.k <= a.runs
), x AS (
  SELECT lang, word, frequency, k, CASE WHEN cons > 0 THEN lpad(bin(cons), {c}, '0') END AS onset, lpad(bin(vow), {v}, '0') AS nucleus, CASE WHEN coda > 0 THEN lpad(bin(coda), {c}, '0') END AS coda FROM y
), joint AS (
  SELECT e.lang, e.word, e.frequency, coalesce(j.pattern, '[]') AS pattern FROM entries e LEFT JOIN (
    SELECT lang, word, '[' || string_agg('{{' || array_to_string(list_filter(['"onset":"' || onset || '"', '"nucleus":"' || nucleus || '"', '"coda":"' || coda || '"'], lambda z: z IS NOT NULL), ',') || '}}', ',' ORDER BY k) || ']' AS pattern FROM x GROUP BY lang, word) j ON e.lang = j.lang AND e.word = j.word
), counts AS MATERIALIZED (
  SELECT lang, component, pattern, sum(frequency)::BIGINT AS n FROM (
    SELECT lang, 'onset' AS component, onset AS pattern, frequency FROM x UNION ALL SELECT lang, 'nucleus', nucleus, frequency FROM x UNION ALL SELECT lang, 'coda', coda, frequency FROM x UNION ALL SELECT lang, 'joint', pattern, frequency FROM joint)
  WHERE pattern IS NOT NULL GROUP BY lang, component, pattern
)"""

_METRICS = """, h AS (
  SELECT lang, component, -sum(n / total * log2(n / total)) AS entropy, count(*) AS n_patterns, any_value(total)::BIGINT AS total FROM (SELECT *, sum(n) OVER (PARTITION BY lang, component) AS total FROM counts) GROUP BY lang, component
), u AS (
  SELECT *, n_patterns / pow(2, CASE component WHEN 'nucleus' THEN {v} WHEN 'joint' THEN NULL ELSE {c} END) AS utilisation FROM h
)
SELECT lang, component, n_patterns, total, CASE WHEN utilisation < 0.25 THEN 'over' WHEN utilisation > 0.75 THEN 'under' WHEN utilisation IS NOT NULL THEN 'right' END AS provision, round(entropy, 6) AS entropy,
       round(sum(CASE WHEN component <> 'joint' THEN entropy END) OVER (PARTITION BY lang) - max(CASE WHEN component = 'joint' THEN entropy END) OVER (PARTITION BY lang), 6) AS redundancy, round(utilisation, 12) AS utilisation FROM u"""


#: The last six syllables, the last first, filled with zeros; and the parity of each place over all slots.
_BITS = """, w AS (
  SELECT lang, word, rpad(coalesce(string_agg(coalesce(onset, '') || nucleus || coalesce(coda, ''), '' ORDER BY k DESC), ''), {w} * 6, '0') AS bits FROM (SELECT e.lang, e.word, k, onset, nucleus, coda, row_number() OVER (PARTITION BY e.lang, e.word ORDER BY k DESC) AS r FROM entries e LEFT JOIN x ON e.lang = x.lang AND e.word = x.word) WHERE r <= 6 GROUP BY lang, word
)
SELECT lang, word, bits, array_to_string(list_transform(range(1, {w} + 1), lambda i: (len(list_filter(range(0, 6), lambda s: substr(bits, s * {w} + i, 1) = '1')) % 2)::VARCHAR), '') AS folded FROM w"""


def _cross_sql() -> str:
    index, matrix = feat.distance_matrix({p: dict(enumerate(universal(p))) for p in NAMES})
    ids = f"list_transform(tokens, lambda t: ({_map({p: i + 1 for p, i in index.items()})})[t])"
    rows = " UNION ALL ".join(f"SELECT phrase, {_q(k)} AS lang, regexp_extract_all({_spelled('phrase', k)}, {_q(text.alternation(SPECS[k].phones))}) AS tokens FROM phrases" for k in SPECS)
    m = "[" + ", ".join("[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in r) + "]" for r in matrix) + "]"
    return f"""WITH {_phrases_sql(True)}, matrix AS (SELECT {m} AS m), t AS MATERIALIZED (SELECT phrase, lang, {ids} AS b, list_transform({ids}, lambda x: x::DOUBLE) AS a FROM ({rows}) WHERE len(tokens) > 0), c AS MATERIALIZED (
  SELECT x.phrase AS concept, x.lang AS lang_a, y.lang AS lang_b, x.a AS a, y.b AS b FROM t x JOIN t y ON x.phrase = y.phrase AND x.lang < y.lang)
SELECT concept, lang_a, lang_b, round({_EDIT} / greatest(len(a), len(b)), 6) AS value FROM c, matrix"""


def _coarticulated_sql() -> str:
    """Each phoneme with its neighbours is shifted by the rules in turn; the distances of all such contexts make the matrix."""
    at = lambda v, n: f"{v}[{coarticulation.AT[n] + 1}]"
    holds = {
        "vowel": "{syl} = 1", "consonant": "{syl} <> 1", "high vowel": "{syl} = 1 AND {hi} = 1", "round vowel": "{syl} = 1 AND {round} = 1", "back vowel": "{syl} = 1 AND {back} = 1", "nasal": "{syl} <> 1 AND {nas} = 1",
        "velar": "{syl} <> 1 AND {hi} = 1 AND {back} = 1", "labial": "{syl} <> 1 AND {lab} = 1", "stop": "{son} = -1 AND {cont} = -1",
    }
    is_ = lambda kind, v: "(" + holds[kind].format(**{n: at(v, n) for n in coarticulation.AT}) + ")"
    shifted = {n: f"{at('x', n)}::DOUBLE" for n in coarticulation.AT}
    for r in coarticulation.RULES:
        if not r.spread:
            other = "nx" if r.who == 1 else "pv"
            by = f"{r.direction or at(other, r.feature)} * {r.magnitude}::DOUBLE"
            shifted[r.feature] = f"CASE WHEN {is_(r.me, 'x')} AND {other} IS NOT NULL AND {is_(r.other, other)} THEN least(1::DOUBLE, greatest(-1::DOUBLE, {shifted[r.feature]} + {by})) ELSE {shifted[r.feature]} END"
    vectors = "MAP {" + ", ".join(f"{_q(p)}: {list(universal(p))}" for p in sorted(SPECS["en"].features)) + "}"
    return f"""WITH {_phrases_sql()}, t AS (
  SELECT phrase, pos, tok, lag(tok) OVER w AS p, lead(tok) OVER w AS n FROM (SELECT phrase, unnest(tokens) AS tok, unnest(range(1, len(tokens) + 1)) AS pos FROM phrases) WINDOW w AS (PARTITION BY phrase ORDER BY pos)
), ctx AS MATERIALIZED (
  SELECT p, tok, n, row_number() OVER (ORDER BY p, tok, n) AS id FROM (SELECT DISTINCT p, tok, n FROM t)
), raw AS MATERIALIZED (SELECT id, ({vectors})[tok] AS x, ({vectors})[p] AS pv, ({vectors})[n] AS nx FROM ctx
), vec AS MATERIALIZED (SELECT id, [{', '.join(shifted[n] for n in coarticulation.AT)}] AS x FROM raw
), cost AS (
  SELECT a.id AS i, b.id AS j, list_filter(range(1, 25), lambda f: abs(a.x[f]) >= 0.01::DOUBLE OR abs(b.x[f]) >= 0.01::DOUBLE) AS live, a.x AS p, b.x AS q FROM vec a, vec b
), cells AS (
  SELECT i, j, CASE WHEN len(live) = 0 THEN 0::DOUBLE ELSE list_sum(list_transform(live, lambda f: abs(p[f] - q[f]) * 0.5::DOUBLE)) / len(live) END AS d FROM cost
), matrix AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(d ORDER BY j) AS r FROM cells GROUP BY i)
), p AS MATERIALIZED (SELECT phrase, list(id ORDER BY pos) AS b, list(id::DOUBLE ORDER BY pos) AS a FROM t JOIN ctx ON t.p IS NOT DISTINCT FROM ctx.p AND t.tok = ctx.tok AND t.n IS NOT DISTINCT FROM ctx.n GROUP BY phrase
), c AS MATERIALIZED (SELECT x.phrase AS pa, y.phrase AS pb, x.a AS a, y.b AS b FROM p x, p y)
SELECT pa AS a, pb AS b, round({_EDIT} / greatest(len(c.a), len(c.b)), 6) AS value FROM c, matrix""".replace("list_reduce(a,", "list_reduce(c.a,").replace("len(b)", "len(c.b)").replace("b[len(row)]", "c.b[len(row)]").replace("c.c.b", "c.b")


def oracles() -> dict[str, str]:
    tag = lambda v: f"b:{str(v).lower()}" if isinstance(v, bool) else f"s:{v}"
    long = ", ".join(f"({_q(k)}, {_q(p)}, {_q(n)}, {_q(tag(v))})" for k, s in SPECS.items() for p, f in s.features.items() for n, v in f.items())
    by_lang = f"""f(lang, phoneme, feature, value) AS (VALUES {long}), p AS (SELECT DISTINCT lang, phoneme FROM f), cells AS (
  SELECT a.lang AS la, a.phoneme AS a, b.lang AS lb, b.phoneme AS b, feature,
         max(CASE WHEN f.lang = a.lang AND f.phoneme = a.phoneme THEN value END) AS x, max(CASE WHEN f.lang = b.lang AND f.phoneme = b.phoneme THEN value END) AS y
  FROM p a, p b, f WHERE %s AND ((f.lang = a.lang AND f.phoneme = a.phoneme) OR (f.lang = b.lang AND f.phoneme = b.phoneme))
  GROUP BY ALL
), d AS (SELECT la, a, lb, b, sum((x IS DISTINCT FROM y)::INT) / count(*) AS distance FROM cells GROUP BY ALL)"""
    vec = ", ".join(f"({_q(r)}, {list(universal(r))})" for r in [*CONSONANTS, *VOWELS, *NASAL_VOWELS])
    with_words = f"WITH {_words_sql()} "
    choose = lambda xs, i: f"(['{chr(39) + chr(44) + chr(39)}'])".replace("','", "', '".join(xs)) + f"[({i}) % {len(xs)} + 1]"
    size, first = "length(prons)", "unicode(word)"
    marked = f""", m AS (SELECT lang, word, left(prons, cut_at) || {choose(_MARKS, f'length(word) + {first}')} || CASE WHEN length(word) % 3 = 0 THEN {choose(_MARKS, 'length(word)')} ELSE '' END || substr(prons, cut_at + 1) || {choose(_DECOMPOSED, f'length(word) + {size}')} AS d
  FROM (SELECT *, (length(word) * 7 + {first}) % ({size} + 1) AS cut_at FROM raw))"""
    bits = [(k, p, int(p in s.vowels), int(feat.bits_of(f, s.consonant_columns), 2), int(feat.bits_of(f, s.vowel_columns), 2)) for k, s in SPECS.items() for p, f in s.features.items()]
    bits_sql = ", ".join(f"({_q(k)}, {_q(p)}, {v}, {c}, {n})" for k, p, v, c, n in bits)
    encoded = _ENCODED.format(words=_words_sql(min_length=1, min_tokens=1), bits=bits_sql, c=len(SPECS["en"].consonant_columns), v=len(SPECS["en"].vowel_columns))
    return {
        "reverse_lookup": _scan_sql(("fr",), TOP) + "SELECT * FROM best",
        "multi_language_scan": _scan_sql(TARGETS, 1) + "SELECT * FROM best",
        "recovered_words": _scan_sql(TARGETS, 1) + "SELECT count(*) AS n, count(*) FILTER (distance <= 0.3::DOUBLE) AS hits, count(*) FILTER (distance IS NULL) AS missing, round(count(*) FILTER (distance <= 0.3::DOUBLE) / count(*), 6) AS recall FROM (SELECT phrase, min(distance) AS distance FROM phrases LEFT JOIN best USING (phrase) GROUP BY phrase)",
        "words": with_words + "SELECT lang, word FROM words",
        "g2p_rules": with_words + "SELECT lang, word, prons FROM raw",
        "g2p_dictionary_or_rules": with_words + f"SELECT 'fr' AS lang, word, CASE WHEN word IN (SELECT word FROM raw WHERE lang = 'fr') THEN 'ˈ' ELSE '' END || prons AS prons FROM (SELECT word, {_spelled('word', 'fr')} AS prons FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), {_q(dictionary.LETTERS)})) AS word FROM benchmark)) WHERE prons <> ''",
        "pretokenize": with_words + "SELECT lang, word, ipa, array_to_string(tokens, ' ') AS tokens, n_tok FROM entries",
        "clean_phones": f"{with_words}{marked} SELECT lang, word, translate(d, 'ˈˌːˑ‿', '') AS clean, translate(d, 'ːˑ‿', '') AS with_stress, translate(d, 'ˈˌ‿', '') AS with_length FROM m",
        "stress_marks": f"{with_words}{marked} SELECT lang, word, coalesce(array_to_string(list_transform(list_filter(range(1, length(d) + 1), lambda i: substr(d, i, 1) IN ('ˈ', 'ˌ')), lambda i: length(translate(substr(d, 1, i - 1), 'ˈˌ', '')) || CASE substr(d, i, 1) WHEN 'ˈ' THEN ':primary' ELSE ':secondary' END), ','), '') AS marks FROM m",
        "syllabification": with_words + _SYLLABLES.format(ranks=_map({p: syllables.sonority(p) for p in NAMES}), vowels=", ".join(map(_q, sorted({p for k in SPECS for p in SPECS[k].vowels})))),
        "entropy_metrics": encoded + _METRICS.format(c=len(SPECS["en"].consonant_columns), v=len(SPECS["en"].vowel_columns)),
        "top_patterns": encoded + " SELECT * FROM (SELECT lang, component, pattern, n, row_number() OVER (PARTITION BY lang, component ORDER BY n DESC, pattern) AS rank FROM counts) WHERE rank <= 20",
        "coarticulated": _coarticulated_sql(),
        "word_bits": _ENCODED.format(words=_words_sql(), bits=bits_sql, c=len(SPECS["en"].consonant_columns), v=len(SPECS["en"].vowel_columns)) + _BITS.format(w=SPECS["en"].syllable_bits),
        "phrase_hamming": _ENCODED.format(words=_phrases_sql() + ", entries AS (SELECT 'en' AS lang, phrase AS word, tokens, 1 AS frequency FROM phrases)", bits=bits_sql, c=len(SPECS["en"].consonant_columns), v=len(SPECS["en"].vowel_columns)) + _BITS.format(w=SPECS["en"].syllable_bits).replace("SELECT lang, word, bits, array", ", z AS MATERIALIZED (SELECT word, bits FROM w) SELECT x.word AS a, y.word AS b, round(len(list_filter(range(1, length(x.bits) + 1), lambda i: substr(x.bits, i, 1) = substr(y.bits, i, 1))) / length(x.bits), 6) AS value FROM z x, z y --").replace("\n)\n, z", "\n), z"),
        "cross_language": _cross_sql(),
        "phoneme_distances": "WITH " + by_lang % "a.lang = b.lang" + " SELECT la AS lang, a, b, round(distance, 6) AS distance FROM d",
        "universal_distances": f"WITH v(p, x) AS (VALUES {vec}) SELECT a, b, round(CASE WHEN n = 0 THEN 0 ELSE k / n END, 6) AS distance FROM (SELECT a.p AS a, b.p AS b, len(list_filter(range(1, 25), lambda i: a.x[i] <> 0 AND b.x[i] <> 0)) AS n, len(list_filter(range(1, 25), lambda i: a.x[i] <> 0 AND b.x[i] <> 0 AND a.x[i] <> b.x[i])) AS k FROM v a, v b)",
        "invert_features": "WITH " + by_lang % "a.lang = 'en' AND b.lang <> 'en'" + " SELECT lb AS lang, a AS phoneme, b AS match, round(distance, 6) AS distance FROM d WHERE distance <= 0.6::DOUBLE",
        "invert_phrases": "WITH " + by_lang % "a.lang = 'en' AND b.lang = 'fr'" + f", {_phrases_sql()}, t AS (SELECT phrase, unnest(range(0, len(tokens))) AS pos, unnest(tokens) AS token FROM phrases) SELECT phrase, pos, token, coalesce(string_agg(b, ' ' ORDER BY b) FILTER (distance <= 0.34::DOUBLE), '') AS matches FROM t LEFT JOIN d ON d.a = t.token GROUP BY phrase, pos, token",
        "phrase_distances": f"WITH {_phrases_sql()}, {_matrix_sql()}, p AS (SELECT phrase, {_ids('tokens')} AS b, list_transform({_ids('tokens')}, lambda x: x::DOUBLE) AS a FROM phrases), c AS MATERIALIZED (SELECT p.phrase AS pa, q.phrase AS pb, p.a AS a, q.b AS b, m FROM p, p q, matrix) SELECT pa AS a, pb AS b, round({_EDIT} / greatest(len(c.a), len(c.b)), 6) AS value FROM c".replace("list_reduce(a,", "list_reduce(c.a,").replace("len(b)", "len(c.b)").replace("b[len(row)]", "c.b[len(row)]").replace("c.c.b", "c.b"),
        "sign_bit_neighbours": "WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS s FROM embeddings), d AS (SELECT q.vec_id AS query, v.vec_id AS vec_id, round(len(list_filter(range(1, len(v.s) + 1), lambda i: v.s[i] = q.s[i])) / len(v.s), 6) AS similarity FROM v, v q WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.s) = len(v.s)), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM d) SELECT * FROM r WHERE rank <= 5",
        "sonority": with_words + f"SELECT lang, word, array_to_string(list_transform(tokens, lambda t: ({_map({p: syllables.sonority(p) for p in NAMES})})[t]), '') AS ranks FROM entries",
        "phoneme_entropy": with_words + ", c AS (SELECT lang, t, count(*) AS n FROM (SELECT lang, unnest(tokens) AS t FROM entries) GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY lang) AS p FROM c) SELECT lang, 'phoneme' AS component, round(-sum(p * log2(p)), 6) AS entropy, count(*) AS n_patterns, sum(n)::BIGINT AS total FROM s GROUP BY lang",
        "enriched_events": f"SELECT event_id, {_spelled('lower(event_type)', 'en')} AS ipa, len(regexp_extract_all({_spelled('lower(event_type)', 'en')}, {_q(text.alternation(SPECS['en'].phones))})) AS n_tok FROM events",
    }


ORACLES = oracles()
