import os

import pytest

DIRECTORY = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, "
    "_id STRING, _text STRING, size INT, SCORE INT, _block INT, component_id INT"
)
LONG = "wörter und zeilen the end of it\n" * 4000


@pytest.fixture(scope="session")
def directory():
    if not os.path.isdir(DIRECTORY):
        pytest.skip("no test tables here")
    return DIRECTORY


def table(spark, rows):
    """Documents with extra columns whose names clash with those the operators use."""
    full = [(i, t, la, s, len(t or ""), "x", "y", 1, 2, 3, 4) for i, t, la, s in rows]
    return spark.createDataFrame(full, SCHEMA)


EDGES = [
    (1, None, None, None),
    (2, "", "en", "b"),
    (3, " \t\n ", "de", ""),
    (4, LONG, "de", "a"),
    (5, "The same text, twice over.\nA line", "en", "a"),
    (5, "The same text, twice over.\nA line", "en", "a"),
    (6, "The same text, twice over.\nA line", "en", "a"),
    (None, "no id here at all", "en", "b"),
    (7, "12345 67890 !!", None, "b"),
    (8, "日本語 é \x00 ß ÀB \U0001f600 " + "x" * 300, "fr", None),
    (-9, "a\\n <|im_end|> ▁ b", "es", "c"),
]


@pytest.fixture
def edges(spark):
    return table(spark, EDGES)


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
