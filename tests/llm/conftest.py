import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word another thing and more of it " * 20_000


def awkward_rows():
    """Null and empty texts, a null doc_id, repeated rows, a very long text, one without white space."""
    return [
        (0, None, "en", "s", None),
        (1, "", "en", "s", 0),
        (2, " \t\n ", None, None, 3),
        (3, "One text of a few words, repeated here and there.", "en", "s", 49),
        (3, "One text of a few words, repeated here and there.", "en", "s", 49),
        (4, "One text of a few words, repeated here and there.", "en", "s", 49),
        (None, "One text of a few words, repeated here and there.", "en", "s", 49),
        (5, LONG, "en", "s", len(LONG)),
        (6, "x" * 100_000, "en", "s", 100_000),
        (7, "12 34 -- !!", "en", "s", 11),
        (8, "▁mark 漢字\r\n\x00 é", "fr", "s", 14),
    ]


#: Names that the operators use themselves.
CLASHING = ("component_id", "n_tokens", "bucket", "row", "rank", "id", "key", "print", "kept", "score", "part", "n", "__gone", "grade", "spans", "pretoken")


@pytest.fixture(scope="session")
def awkward(spark):
    df = spark.createDataFrame(awkward_rows(), DOCS)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
