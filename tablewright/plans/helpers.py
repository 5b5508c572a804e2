"""What several query modules use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.operators.statements import run
from tablewright.plans.registry import Tables
from tablewright.session import isolated_session
from tablewright.sources.tables import register


def statement(t: Tables, sql: str, *names: str) -> DataFrame:
    """The rows of one SQL statement over the named tables, in a session of its own."""
    result = run(register(isolated_session(t.spark), t.directory, *names), sql)
    if result.kind != "rows":
        raise ValueError(f"no rows: {result.error or result.kind}")
    return result.df


def command(spark, sql: str) -> None:
    """One SQL statement that has no rows."""
    result = run(spark, sql)
    if not result.success:
        raise ValueError(str(result.error))


def n_rows() -> Column:
    return F.count(F.lit(1))


def rounded_sum(value: Column | str, digits: int = 2) -> Column:
    return F.round(F.sum(value), digits)


def rounded_avg(value: Column | str, digits: int = 6) -> Column:
    return F.round(F.avg(value), digits)
