from tablewright.operators.render import (
    grid,
    preview,
    rows_as_json,
    rows_as_text,
    text_header,
    text_report,
)
from tests.conftest import rows

NESTED = """
SELECT 1 AS a, named_struct('p', 1, 'q', CAST(NULL AS INT)) AS st, map('k', 2) AS m, array(1, 2) AS ar,
       DATE '2024-01-02' AS d, CAST(1.5 AS DECIMAL(10,2)) AS de, CAST(NULL AS STRING) AS n
"""


def values(df):
    return [row[0] for row in df.collect()]


def test_json_leaves_nulls_out(spark):
    df = spark.sql(NESTED)
    assert values(rows_as_json(df)) == [
        '{"a":1,"st":{"p":1},"m":{"k":2},"ar":[1,2],"d":"2024-01-02","de":1.50}'
    ]
    assert values(rows_as_json(df)) == df.toJSON().collect()


def test_text_writes_null(spark):
    assert values(rows_as_text(spark.sql(NESTED))) == [
        "1 | {1, null} | {k -> 2} | [1, 2] | 2024-01-02 | 1.50 | null"
    ]


def test_text_of_awkward_and_equal_names(spark):
    df = spark.sql("SELECT 1 AS `a.b`, 2 AS `x`, 3 AS `x`")
    assert values(rows_as_text(df)) == ["1 | 2 | 3"]
    assert text_header(df) == ["a.b | x | x", "-" * 11]


def test_report(spark):
    df = spark.sql("SELECT 1 AS id, 'Alice' AS name")
    assert text_report(df) == "id | name\n---------\n1 | Alice\n\nTotal rows: 1"
    assert text_report(df.where("id > 1")) == "Empty result set"
    assert text_report(spark.range(5), 2).endswith("\n\nonly showing top 2 rows")


def test_preview_is_bounded_and_the_grid_says_so(spark):
    df = spark.range(1001)
    assert preview(df).count() == 1000
    assert "only showing top 1000 rows" in grid(df)
    assert "x" * 100 in grid(spark.sql("SELECT repeat('x', 100) AS long"))
    assert rows(preview(df.where("id < 0"))) == []
