import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns of clashing names."""
    rows = [
        (1, None, "en", "a", None), (2, "", None, "a", 0), (3, "   \n\t ", "en", None, 6), (4, "one", "en", "b", 3),
        (5, "a b c d e f g " * 4000, "en", "b", 56000), (6, "same words here for all of us", "en", "b", 29),
        (7, "same words here for all of us", "en", "b", 29), (7, "same words here for all of us", "en", "b", 29),
        (None, "no id at all but words", "en", "c", 22), (8, "日本語 text \U0001f600 ü", "en", "c", 13), (9, "x" * 5000, "de", "c", 5000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    names = ("fp", "length", "h", "_row", "_shard", "score", "label", "n", "count", "pos", "line", "start", "kind", "file", "src")
    return df.withColumns({k: F.lit(f"clash {k}") for k in names})


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
