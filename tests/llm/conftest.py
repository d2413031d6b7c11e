import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, extra=True):
    """rows of (doc_id, text, lang, source); with columns whose names the operators use inside."""
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], COLUMNS)
    if extra:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit(c) for c in ("slot", "before", "fp", "id", "word", "n", "row", "src", "m", "keep", "node", "bucket")})
    return df


LONG = "lorem ipsum dolor sit amet " * 6000
ODD = [
    (1, None, "en", "a"), (2, "", None, "a"), (3, "   \n\t ", "en", None), (4, "one", "en", "a"), (5, LONG, "en", "b"),
    (6, LONG, "en", "b"), (7, "Größe über ñandú 👩‍🚀 ▁▁ x  y", "de", "b"), (7, "Größe über ñandú 👩‍🚀 ▁▁ x  y", "de", "b"),
    (None, "a row without an id but with words", "en", "a"), (None, None, None, None), (9, "x" * 30000, "en", "a"),
    (10, "0" * 20000, "en", "a"), (11, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (12, "the quick brown fox jumps over the lazy dog", "fr", "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return docs_of(spark, ODD).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
