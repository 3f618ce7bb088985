import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, clashing columns."""
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(60_000))
    body = " ".join(f"alpha{i}" for i in range(80))
    rows = [
        (1, None, "en", "a", 0),
        (2, "", None, "a", 0),
        (3, " \n\t ", "en", None, 3),
        (4, body, "en", "a", None),
        (4, body, "en", "a", None),
        (5, body, "de", "b", 1),
        (6, long, "en", "b", 1),
        (7, "Ünï— 漢字 \U0001f600 tail", None, None, None),
        (None, body, "en", "a", 1),
        (None, None, None, None, None),
        (8, "x", "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    extra = "n n_words host rid key keys row spans shard content class token salt _id _row hits items masked".split()
    for name in extra:
        df = df.selectExpr("*", f"'clash' as {name}")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
