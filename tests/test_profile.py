from tablewright.operators.profile import profile, schema_summary
from tests.conftest import rows


def test_profile(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None)], "id INT, `v.w` DOUBLE")
    assert rows(profile(df)) == [("id", "int", True, 2, 0), ("v.w", "double", True, 2, 1)]
    assert rows(profile(df.where("id > 5"))) == [("id", "int", True, 0, 0), ("v.w", "double", True, 0, 0)]


def test_profile_of_equal_names_and_nested_types(spark):
    df = spark.sql("SELECT 1 AS a, array(1) AS a")
    assert [(r[0], r[1], r[3]) for r in profile(df).collect()] == [("a", "int", 1), ("a", "array<int>", 1)]


def test_summary(spark):
    text = schema_summary(spark.range(3))
    assert "id: long" in text and text.endswith("Row count: 3")
