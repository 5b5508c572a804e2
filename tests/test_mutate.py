import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.errors import AnalysisException, ArithmeticException
from pyspark.sql import functions as F

from tablewright.operators.mutate import append_rows, delete_rows, update_rows
from tests.conftest import rows

PEOPLE = [(1, "Alice", 100.5), (2, "Bob", 200.75), (3, "Charlie", 300.25)]


@pytest.fixture
def people(spark):
    return spark.createDataFrame(PEOPLE, "id INT, name STRING, value DOUBLE")


@pytest.fixture
def with_null(spark):
    return spark.createDataFrame([(1, 10.0), (2, None)], "id INT, v DOUBLE")


def test_update(people):
    changed = update_rows(people, {"value": "999.99"}, "name = 'Alice'")
    assert rows(changed) == [(1, "Alice", 999.99), *PEOPLE[1:]]
    assert changed.schema == people.schema


def test_update_with_expression_and_in(people):
    changed = update_rows(people, {"value": F.col("value") * 1.1}, F.col("id").isin(1, 2))
    assert [round(r[2], 3) for r in rows(changed)] == [110.55, 220.825, 300.25]


def test_right_hand_sides_see_the_old_row(spark):
    df = spark.createDataFrame([(1, 2)], "a INT, b INT")
    assert rows(update_rows(df, {"a": "b", "b": "a"})) == [(2, 1)]


def test_a_null_predicate_leaves_the_row(with_null):
    assert rows(update_rows(with_null, {"v": "0"}, "v > 5")) == [(1, 0.0), (2, None)]
    assert rows(delete_rows(with_null, "v > 5")) == [(2, None)]
    assert rows(delete_rows(with_null, "v < 5")) == [(1, 10.0), (2, None)]


def test_delete(people):
    assert rows(delete_rows(people, "name = 'Charlie'")) == PEOPLE[:2]
    assert rows(delete_rows(people)) == []


def test_expressions_run_for_selected_rows_only(spark):
    df = spark.createDataFrame([(0, 1), (5, 1)], "a INT, b INT")
    assert rows(update_rows(df, {"b": "CAST(10 / a AS INT)"}, "a <> 0")) == [(0, 1), (5, 2)]


def test_types_are_kept_or_refused(people):
    with pytest.raises(AnalysisException):
        update_rows(people, {"value": "'text'"})
    with pytest.raises(ArithmeticException):
        update_rows(people, {"id": "3000000000"}).collect()
    assert rows(update_rows(people, {"name": "id"}, "id = 1"))[0] == (1, "1", 100.5)
    with pytest.raises(ValueError):
        update_rows(people, {"nme": "1"})


def test_names_in_any_case_and_by_position(spark, people):
    changed = update_rows(people, {"VALUE": "0"}, "ID < 3")
    assert changed.columns == people.columns
    assert rows(changed.where("value = 0").select("id")) == [(1,), (2,)]
    more = spark.sql("SELECT * FROM VALUES (4, 'Dora', 1.5D)")
    assert rows(append_rows(people, more, by_position=True)) == [*PEOPLE, (4, "Dora", 1.5)]


def test_append(spark, people):
    more = spark.createDataFrame([("Dora", 4)], "name STRING, id BIGINT")
    assert rows(append_rows(people, more)) == [*PEOPLE, (4, "Dora", None)]
    with pytest.raises(ValueError, match="wrong"):
        append_rows(people, more.withColumnRenamed("name", "wrong"))
    with pytest.raises(AnalysisException):
        append_rows(people, spark.sql("SELECT 4 AS id, 'many' AS value"))


def test_a_required_column_takes_no_null(spark):
    target = spark.range(2)
    assert not target.schema["id"].nullable
    assert rows(append_rows(target, spark.sql("SELECT CAST('7' AS BIGINT) AS id"))) == [(0,), (1,), (7,)]
    with pytest.raises(Exception, match="NULL in column id"):
        append_rows(target, spark.sql("SELECT CAST(NULL AS INT) AS id")).collect()
    assert rows(update_rows(target, {"id": "id + 5"}, "id = 1")) == [(0,), (6,)]
    with pytest.raises(Exception, match="NULL in column id"):
        update_rows(target, {"id": "NULLIF(id, 1)"}).collect()


def test_awkward_names(spark):
    df = spark.sql("SELECT 1 AS `a.b`, 2 AS `c``d`")
    assert rows(update_rows(df, {"a.b": "`c``d` + 1"}, "`a.b` = 1")) == [(3, 2)]


values = st.one_of(st.none(), st.integers(-5, 5))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(values, values), max_size=8), st.integers(-5, 5))
def test_kept_and_deleted_rows_make_the_table(spark, data, bound):
    df = spark.createDataFrame(data, "a INT, b INT")
    where = f"a < {bound} AND b > a"
    kept, deleted = delete_rows(df, where), df.where(where)
    assert rows(kept.unionAll(deleted)) == rows(df)
    changed = update_rows(df, {"b": "b + 1"}, where)
    assert changed.count() == len(data)
    expected = [
        (a, b + 1) if a is not None and b is not None and a < bound and b > a else (a, b)
        for a, b in data
    ]
    assert rows(changed) == sorted(expected, key=repr)
