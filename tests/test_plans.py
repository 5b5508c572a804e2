"""What the physical plans must and must not contain."""

import os
import re

import pytest

from tablewright.plans.catalogue import QUERIES

DIRECTORY = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIRECTORY), reason="no test tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """As on large tables: no side is small enough to be broadcast by its size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


NO_SHUFFLE = ["b05_rows_as_text", "b10_update", "b11_delete", "b15_row_filter", "p38_strings", "p44_json_read"]


@pytest.mark.parametrize("name", NO_SHUFFLE)
def test_row_by_row_work_does_not_shuffle(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, DIRECTORY))


@pytest.mark.parametrize(
    "name, pushed, columns",
    [
        ("b01_execute_statement", "LessThanOrEqual(l_shipdate", 6),
        ("b15_row_filter", "GreaterThan(c_acctbal,0.0)", 4),
        ("r06_filter_in", "In(o_orderpriority", 2),
        ("p18_exists", "GreaterThan(l_quantity,49.0)", 2),
        ("p15_as_of_join", "In(event_type", 4),
    ],
)
def test_filters_and_columns_reach_the_scan(spark, name, pushed, columns):
    text = plan(QUERIES[name](spark, DIRECTORY))
    scans = [line for line in text.splitlines() if "FileScan" in line and pushed in line]
    assert scans
    read = re.search(r"FileScan parquet \[([^\]]*)\]", scans[0]).group(1)
    assert len(read.split(",")) == columns


RELATIONAL = sorted(name for name in QUERIES if re.match(r"p(09|1\d|2\d|3\d|4\d)_", name))
ONE_SIDE_OF_FIXED_SIZE = {"p12_cross_join", "p13_theta_join"}


@pytest.mark.parametrize("name", RELATIONAL)
def test_joins_hash_or_merge(spark, no_broadcast, name):
    text = plan(QUERIES[name](spark, DIRECTORY))
    assert "CartesianProduct" not in text
    assert ("NestedLoop" in text) == (name in ONE_SIDE_OF_FIXED_SIZE)


def test_bucketed_tables_join_without_a_shuffle(spark, no_broadcast):
    text = plan(QUERIES["p03_bucketed"](spark, DIRECTORY))
    assert "SortMergeJoin" in text
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1  # the final count per status


def test_partition_filter_prunes(spark):
    text = plan(QUERIES["p03_partitioned"](spark, DIRECTORY))
    assert re.search(r"PartitionFilters: \[[^\]]*o_orderstatus#\d+ = F", text)


@pytest.mark.parametrize(
    "name, operator",
    [
        ("p16_hint_sort_merge", "SortMergeJoin"),
        ("p16_hint_shuffle_hash", "ShuffledHashJoin"),
        ("p16_hint_broadcast", "BroadcastHashJoin"),
    ],
)
def test_hints_choose_the_join(spark, name, operator):
    assert operator in plan(QUERIES[name](spark, DIRECTORY))
