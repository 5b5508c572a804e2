"""Statements about tables and names, in the forms users submit them."""

import uuid

import pytest

from tablewright.operators.statements import run
from tablewright.session import isolated_session
from tests.conftest import rows


@pytest.fixture
def session(spark):
    return isolated_session(spark)


@pytest.fixture
def name(session):
    name = f"t_{uuid.uuid4().hex}"
    yield name
    session.sql(f"DROP TABLE IF EXISTS spark_catalog.default.{name}")


def ok(session, sql):
    result = run(session, sql)
    assert result.success, result.error
    return result


def test_create_forms(session, name, folder):
    ok(session, f"CREATE TABLE {name} (id INT, name STRING) USING parquet LOCATION '{folder}/t'")
    ok(session, f"CREATE TABLE IF NOT EXISTS {name} (other INT)")
    assert run(session, f"CREATE TABLE {name} (id INT)").error.condition == "TABLE_OR_VIEW_ALREADY_EXISTS"
    ok(session, f"INSERT INTO {name} VALUES (1, 'Alice'), (2, 'Bob')")
    assert rows(session.read.parquet(f"{folder}/t")) == [(1, "Alice"), (2, "Bob")]
    assert rows(ok(session, f"SELECT * FROM spark_catalog.default.{name}").df) == [(1, "Alice"), (2, "Bob")]
    described = rows(ok(session, f"DESCRIBE TABLE {name}").df.select("col_name", "data_type"))
    assert described == [("id", "int"), ("name", "string")]


def test_listings(session, name):
    ok(session, f"CREATE TABLE {name} (id INT)")
    shown = ok(session, "SHOW TABLES").df.where(f"tableName = '{name}'")
    assert rows(shown.select("isTemporary")) == [(False,)]
    assert name in [table.name for table in session.catalog.listTables()]
    assert ("spark_catalog",) in rows(ok(session, "SHOW CATALOGS").df)
    assert ("default",) in rows(ok(session, "SHOW SCHEMAS IN spark_catalog").df)
    ok(session, f"DROP TABLE {name}")
    ok(session, f"DROP TABLE IF EXISTS {name}")
    assert run(session, f"DROP TABLE {name}").error.condition == "TABLE_OR_VIEW_NOT_FOUND"


def test_use_stays_in_its_session(spark, session):
    schema = f"s_{uuid.uuid4().hex}"
    ok(session, f"CREATE SCHEMA {schema}")
    try:
        ok(session, f"USE {schema}")
        current = "SELECT current_catalog() AS c, current_schema() AS s"
        assert rows(ok(session, current).df) == [("spark_catalog", schema)]
        assert rows(ok(isolated_session(session), current).df) == [("spark_catalog", schema)]
        assert rows(ok(spark, current).df) == [("spark_catalog", "default")]
    finally:
        ok(session, f"DROP SCHEMA {schema}")


def test_maintenance(session, name):
    ok(session, f"CREATE TABLE {name} USING parquet AS SELECT id FROM range(3)")
    ok(session, f"INSERT OVERWRITE {name} SELECT id FROM range(5)")
    ok(session, f"ALTER TABLE {name} ADD COLUMN note STRING")
    ok(session, f"ANALYZE TABLE {name} COMPUTE STATISTICS")
    ok(session, f"CACHE TABLE {name}")
    assert ok(session, f"SELECT * FROM {name}").df.count() == 5
    ok(session, f"UNCACHE TABLE {name}")
    ok(session, f"TRUNCATE TABLE {name}")
    assert ok(session, f"SELECT * FROM {name}").df.count() == 0


def test_a_plain_table_takes_no_update_delete_merge_or_version(session, name):
    ok(session, f"CREATE TABLE {name} (id INT) USING parquet")
    for sql in (
        f"UPDATE {name} SET id = 2",
        f"DELETE FROM {name} WHERE id = 1",
        f"SELECT * FROM {name} VERSION AS OF 0",
        f"MERGE INTO {name} t USING {name} s ON t.id = s.id WHEN MATCHED THEN DELETE",
    ):
        assert not run(session, sql).success


def test_current_time(session):
    df = ok(session, "SELECT current_date() AS today, current_timestamp() AS now").df
    assert df.schema.simpleString() == "struct<today:date,now:timestamp>" and df.count() == 1


def test_insert_store_rules(session, name):
    ok(session, f"CREATE TABLE {name} (v DOUBLE)")
    assert not run(session, f"INSERT INTO {name} VALUES ('text')").success
    ok(session, f"INSERT INTO {name} VALUES (1.1)")
    assert rows(session.table(name)) == [(1.1,)]
