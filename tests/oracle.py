"""Compare a query with its SQL in DuckDB, as multisets of rows with columns sorted by name."""

import datetime
import decimal

import duckdb

from tablewright.sources.tables import TABLES, location


def connect(directory, tables=TABLES):
    connection = duckdb.connect()
    for name in tables:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{location(directory, name)}'")
    return connection


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return float(value)
    if isinstance(value, datetime.datetime):
        return str(value.replace(tzinfo=None))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def check(df, connection, sql):
    relation = connection.sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    assert table(df.columns, df.collect()) == table(relation.columns, relation.fetchall())
