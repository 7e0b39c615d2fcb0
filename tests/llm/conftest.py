import pytest

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, columns with clashing names."""
    long_ = "word " * 30_000 + "a@b.cc "
    rows = [
        (1, None, "en", 0.5, "x"), (2, "", None, 0.5, "x"), (3, "   \n", "en", 0.5, "x"), (4, long_, "en", None, None), (5, "one two three four five six seven", "en", 0.5, "x"),
        (5, "one two three four five six seven", "en", 0.5, "x"), (6, "one two three four five six seven", "fr", 0.5, "x"), (None, "no id here at all", "en", 0.5, "x"), (7, "x", "en", 0.5, "x"), (8, "1234 !!", "en", 0.5, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, node string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("1 = 0")
