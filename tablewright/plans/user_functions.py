"""Functions of the user's own, called from SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablewright.plans.helpers import command
from tablewright.plans.registry import Tables, query
from tablewright.session import isolated_session
from tablewright.sources.tables import register


@query(
    "p50_sql_scalar_function",
    """
    SELECT l_returnflag, MAX(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS dearest
    FROM lineitem GROUP BY l_returnflag
    """,
)
def sql_scalar_function(t: Tables) -> DataFrame:
    """The body is inlined into the plan, so it costs what the expression costs."""
    session = register(isolated_session(t.spark), t.directory, "lineitem")
    command(
        session,
        "CREATE TEMPORARY FUNCTION charged(price DOUBLE, discount DOUBLE, tax DOUBLE) RETURNS DOUBLE "
        "RETURN price * (1 - discount) * (1 + tax)",
    )
    return session.sql(
        "SELECT l_returnflag, MAX(charged(l_extendedprice, l_discount, l_tax)) AS dearest "
        "FROM lineitem GROUP BY l_returnflag"
    )


@query(
    "p50_sql_table_function",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 350000 AND o_orderstatus = 'O'",
)
def sql_table_function(t: Tables) -> DataFrame:
    session = register(isolated_session(t.spark), t.directory, "orders")
    command(
        session,
        "CREATE TEMPORARY FUNCTION open_above(least DOUBLE) "
        "RETURNS TABLE (o_orderkey BIGINT, o_totalprice DOUBLE) "
        "RETURN SELECT o_orderkey, o_totalprice FROM orders "
        "WHERE o_totalprice > least AND o_orderstatus = 'O'",
    )
    return session.sql("SELECT * FROM open_above(350000)")


@query(
    "p51_pandas_udf",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 2 + l_tax AS scored FROM lineitem
    """,
)
def vectorised_function(t: Tables) -> DataFrame:
    session = register(isolated_session(t.spark), t.directory, "lineitem")

    @F.pandas_udf("double")
    def scored(quantity: pd.Series, tax: pd.Series) -> pd.Series:
        return quantity * 2 + tax

    session.udf.register("scored", scored)
    return session.sql(
        "SELECT l_orderkey, l_linenumber, l_partkey, scored(l_quantity, l_tax) AS scored FROM lineitem"
    )


@query(
    "p51_python_udf",
    "SELECT c_custkey, substr(c_name, 1, 1) || c_nationkey AS code FROM customer",
)
def python_function(t: Tables) -> DataFrame:
    """A plain Python function, sent in Arrow batches."""
    session = register(isolated_session(t.spark), t.directory, "customer")

    @F.udf("string", useArrow=True)
    def code(name: str, nation: int) -> str:
        return f"{name[0]}{nation}"

    session.udf.register("code", code)
    return session.sql("SELECT c_custkey, code(c_name, c_nationkey) AS code FROM customer")


@query(
    "p51_table_udf",
    """
    SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1)::INTEGER - 1 AS place,
           unnest(string_split(p_name, ' ')) AS word FROM part
    """,
)
def table_function(t: Tables) -> DataFrame:
    session = register(isolated_session(t.spark), t.directory, "part")

    @F.udtf(returnType="place: int, word: string")
    class Words:
        def eval(self, text: str):
            yield from enumerate(text.split(" "))

    session.udtf.register("words", Words)
    return session.sql("SELECT p_partkey, place, word FROM part, LATERAL words(p_name)")
