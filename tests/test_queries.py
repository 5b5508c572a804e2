"""Every query against its SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as contract
from tablewright.plans.catalogue import ORACLES, QUERIES
from tests.oracle import check, connect

DIRECTORY = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    return connect(DIRECTORY)


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 6


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    check(QUERIES[name](spark, DIRECTORY), duck, ORACLES[name])


@pytest.mark.parametrize("name", ["r08_sort", "p33_top_k", "p46_null_order", "p46_nulls_first"])
def test_order_of_rows(spark, duck, name):
    name = next(known for known in QUERIES if known.startswith(name))
    got = QUERIES[name](spark, DIRECTORY)
    want = duck.sql(ORACLES[name])
    columns = [want.columns.index(column) for column in got.columns]
    assert [tuple(r) for r in got.collect()] == [tuple(r[i] for i in columns) for r in want.fetchall()]


def test_not_in_an_empty_list_keeps_null(spark, tmp_path):
    spark.sql("SELECT 1L AS o_custkey, 1.0D AS o_totalprice").toPandas().to_parquet(
        tmp_path / "orders.parquet"
    )
    spark.sql("SELECT CAST(NULL AS BIGINT) AS c_custkey UNION ALL SELECT 1L").toPandas().astype(
        "Int64"
    ).to_parquet(tmp_path / "customer.parquet")
    connection = connect(str(tmp_path), ["orders", "customer"])
    check(QUERIES["p18_not_in"](spark, str(tmp_path)), connection, ORACLES["p18_not_in"])


def test_range_frame_counts_whole_days(spark, tmp_path):
    times = "'1998-01-01 08:00:00'", "'1998-01-08 20:00:00'", "'1998-01-09 01:00:00'"
    frame = spark.sql(
        "SELECT 1L AS o_custkey, t AS o_orderdate FROM VALUES "
        + ", ".join(f"(TIMESTAMP_NTZ {t})" for t in times)
        + " AS v(t)"
    ).toPandas()
    frame["o_orderdate"] = frame["o_orderdate"].astype("datetime64[us]")
    frame.to_parquet(tmp_path / "orders.parquet")
    connection = connect(str(tmp_path), ["orders"])
    check(QUERIES["p32_range_frame"](spark, str(tmp_path)), connection, ORACLES["p32_range_frame"])


def test_set_operations_are_distinct_before_the_shuffle(spark):
    for name in ("p36_intersect", "p37_except"):
        plan = QUERIES[name](spark, DIRECTORY)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("HashAggregate") >= 4
