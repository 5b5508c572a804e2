import uuid

import pytest

from tablewright.operators.statements import COMMAND_TEXT, execute, run
from tests.conftest import rows


@pytest.fixture
def name(spark):
    name = f"t_{uuid.uuid4().hex}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_rows_stay_lazy(spark):
    result = run(spark, "SELECT 1 AS id, 'test' AS name")
    assert (result.kind, result.success) == ("rows", True)
    assert rows(result.df) == [(1, "test")]


def test_commands_and_rows(spark, name):
    assert run(spark, f"CREATE TABLE {name} (id INT, value STRING)").kind == "command"
    assert run(spark, f"INSERT INTO {name} VALUES (1, 'alpha'), (2, 'beta')").kind == "command"
    assert rows(run(spark, f"SELECT * FROM {name} ORDER BY id").df) == [(1, "alpha"), (2, "beta")]
    assert run(spark, "SHOW TABLES").kind == "rows"
    assert run(spark, f"DESCRIBE TABLE {name}").kind == "rows"
    assert run(spark, f"DROP TABLE {name}").kind == "command"


def test_filter_and_aggregate(spark, name):
    run(spark, f"CREATE TABLE {name} (id INT, age INT) USING parquet")
    run(spark, f"INSERT INTO {name} VALUES (1, 25), (2, 30), (3, 35)")
    assert rows(run(spark, f"SELECT id FROM {name} WHERE age > 25").df) == [(2,), (3,)]
    total = run(spark, f"SELECT COUNT(*) AS n, SUM(age) AS s, AVG(age) AS a, MAX(age) AS m FROM {name}")
    assert rows(total.df) == [(3, 90, 30.0, 35)]


def test_empty_result_keeps_its_schema(spark, name):
    run(spark, f"CREATE TABLE {name} (id INT)")
    df = run(spark, f"SELECT * FROM {name}").df
    assert df.columns == ["id"] and df.count() == 0


@pytest.mark.parametrize(
    "sql, condition",
    [
        ("SELECT * FROM no_such_table_here", "TABLE_OR_VIEW_NOT_FOUND"),
        ("SELEC 1", "PARSE_SYNTAX_ERROR"),
        ("SELECT 1; SELECT 2", "PARSE_SYNTAX_ERROR"),
        ("", "EMPTY_STATEMENT"),
        ("   ", "EMPTY_STATEMENT"),
    ],
)
def test_errors(spark, sql, condition):
    result = run(spark, sql)
    assert (result.kind, result.success, result.error.condition) == ("error", False, condition)
    assert result.error.message


def test_execute_as_text(spark):
    outcome = execute(spark, "SELECT 1 AS id, CAST(NULL AS STRING) AS name")
    assert outcome.success and "|id |name|" in outcome.result and "NULL" in outcome.result
    assert execute(spark, "SET spark.sql.ansi.enabled").success


def test_a_runtime_error_is_a_failure_with_and_without_a_path(spark, folder):
    sql = "SELECT 1 / (id - 5) AS x FROM range(10)"
    assert not execute(spark, sql).success
    outcome = execute(spark, sql, f"{folder}/out")
    assert not outcome.success and outcome.error.startswith("Failed to write Parquet: DIVIDE_BY_ZERO")


def test_execute_to_parquet(spark, folder):
    outcome = execute(spark, "SELECT id FROM range(1001)", f"{folder}/out")
    assert outcome.success and "Row Count: 1001" in outcome.result and "id: long" in outcome.result
    assert spark.read.parquet(f"{folder}/out").count() == 1001


def test_a_command_ignores_the_path(spark, folder, name):
    outcome = execute(spark, f"CREATE TABLE {name} (id INT)", f"{folder}/out")
    assert (outcome.success, outcome.result) == (True, COMMAND_TEXT)
    import os

    assert not os.path.exists(f"{folder}/out")
