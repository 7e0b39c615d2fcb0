import duckdb
import pytest

from ipaloom.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "part", "benchmark", "embeddings", "events"):
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_gives_the_oracles_rows(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    if name not in plans.ORACLES:
        assert rows
        return
    found = duck.sql(plans.ORACLES[name])
    columns = found.columns
    assert rows == sorted((tuple(dict(zip(columns, r))[c] for c in names) for r in found.fetchall()), key=repr)


def test_short_words_count(spark, duck):
    """Queries without an oracle take words of one and two letters as well."""
    rows = {(r["lang"], r["word"]): r["frequency"] for r in plans._encoded(spark, SF).collect()}
    every = duck.sql(f"SELECT lang, word, count(*) FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '{plans.dictionary.LETTERS}')) AS word FROM documents) GROUP BY ALL").fetchall()
    spelled = {(r["lang"], r["word"]) for r in plans.dictionary.transcribe(spark.createDataFrame([(a, w) for a, w, _ in every], "lang string, word string")).collect()}
    assert rows == {(a, w): n for a, w, n in every if (a, w) in spelled}
    assert {len(w) for _, w in rows} >= {1, 2}
    assert any(len(w) < 3 for r in plans.segmentation(spark, SF).collect() for w in r[2])


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
