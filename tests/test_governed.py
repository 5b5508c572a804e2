import pytest
from pyspark.sql import functions as F

from tablewright.operators.governed import governed, governed_view
from tests.conftest import rows

SCHEMA = "id INT, owner STRING, card STRING"
DATA = [(1, "ann", "1111"), (2, "bob", "2222"), (3, None, "3333")]


@pytest.fixture
def cards(spark):
    return spark.createDataFrame(DATA, SCHEMA)


def test_rows_and_masks(cards):
    seen = governed(cards, "owner = 'ann'", {"card": "concat('**', right(card, 2))"})
    assert rows(seen) == [(1, "ann", "**11")]
    assert seen.columns == cards.columns


def test_unknown_owner_is_hidden(cards):
    assert [r[0] for r in rows(governed(cards, F.col("owner") != "ann"))] == [2]


def test_the_filter_sees_raw_values_and_readers_see_masks(cards):
    seen = governed(cards, "card > '1500'", {"card": F.lit("x"), "owner": "card"})
    assert rows(seen) == [(2, "2222", "x"), (3, "3333", "x")]
    assert seen.where("card = '2222'").count() == 0


def test_view(spark, cards):
    governed_view(cards, "cards_seen", "id < 3", {"owner": "NULL"})
    assert rows(spark.sql("SELECT * FROM cards_seen LIMIT 5")) == [(1, None, "1111"), (2, None, "2222")]
    spark.catalog.dropTempView("cards_seen")
    with pytest.raises(ValueError):
        governed(cards, masks={"crd": "1"})
