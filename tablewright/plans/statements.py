"""Statement forms users submit, over whole tables (R rows of the survey)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tablewright.operators.script import run_script
from tablewright.plans.helpers import command, n_rows, rounded_avg, rounded_sum, statement
from tablewright.plans.registry import Tables, query
from tablewright.session import isolated_session
from tablewright.sources.folders import fresh_folder
from tablewright.sources.tables import location, register


@query("r01_literal_select", "SELECT o_orderkey, 1 AS id, 'test' AS name FROM orders")
def literal_select(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.lit(1).alias("id"), F.lit("test").alias("name"))


@query("r02_table_scan", "SELECT * FROM customer")
def table_scan(t: Tables) -> DataFrame:
    return statement(t, "SELECT * FROM customer", "customer")


@query("r03_projection_alias", "SELECT c_name AS name, c_acctbal AS balance FROM customer")
def projection_alias(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


@query(
    "r04_filter_compare",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000 AND o_totalprice < 300000",
)
def filter_compare(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    return t.orders.where((price > 250000) & (price < 300000)).select("o_orderkey", "o_totalprice")


@query(
    "r05_filter_equal",
    "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING'",
)
def filter_equal(t: Tables) -> DataFrame:
    chosen = (F.col("c_nationkey") == 7) & (F.col("c_mktsegment") == "BUILDING")
    return t.customer.where(chosen).select("c_custkey", "c_name")


@query(
    "r06_filter_in",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
)
def filter_in(t: Tables) -> DataFrame:
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return t.orders.where(urgent).select("o_orderkey", "o_orderpriority")


@query(
    "r07_arithmetic",
    """
    SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net_price,
           l_extendedprice * 1.1::DOUBLE AS raised
    FROM lineitem
    """,
)
def arithmetic(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        (price * (1 - F.col("l_discount"))).alias("net_price"),
        (price * F.lit(1.1)).alias("raised"),
    )


@query("r08_sort", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal, c_custkey")
def sort(t: Tables) -> DataFrame:
    return t.customer.orderBy("c_acctbal", "c_custkey").select("c_custkey", "c_name")


@query(
    "r09_limit",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
)
def limit(t: Tables) -> DataFrame:
    dearest = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)
    return dearest.select("o_orderkey", "o_totalprice")


@query("r10_global_count", "SELECT COUNT(*) AS count FROM lineitem")
def global_count(t: Tables) -> DataFrame:
    return t.lineitem.agg(n_rows().alias("count"))


@query("r11_global_sum", "SELECT ROUND(SUM(l_quantity), 2) AS total FROM lineitem")
def global_sum(t: Tables) -> DataFrame:
    return t.lineitem.agg(rounded_sum("l_quantity").alias("total"))


@query("r12_global_avg", "SELECT ROUND(AVG(o_totalprice), 4) AS avg_price FROM orders")
def global_avg(t: Tables) -> DataFrame:
    return t.orders.agg(rounded_avg("o_totalprice", 4).alias("avg_price"))


@query(
    "r13_global_max",
    "SELECT MAX(o_totalprice) AS top, MIN(o_totalprice) AS bottom, MAX(o_orderdate) AS last FROM orders",
)
def global_max(t: Tables) -> DataFrame:
    return t.orders.agg(
        F.max("o_totalprice").alias("top"),
        F.min("o_totalprice").alias("bottom"),
        F.max("o_orderdate").alias("last"),
    )


def _table(t: Tables) -> tuple:
    """A session, a new table name and a folder for the table."""
    return isolated_session(t.spark), f"t_{uuid.uuid4().hex}", fresh_folder(t.spark, "table")


@query(
    "r14_create_table",
    "SELECT * FROM customer",
)
def create_table(t: Tables) -> DataFrame:
    session, name, folder = _table(t)
    register(session, t.directory, "customer")
    command(
        session,
        f"CREATE TABLE IF NOT EXISTS {name} USING parquet LOCATION '{folder}' AS "
        "SELECT * FROM customer",
    )
    command(session, f"CREATE TABLE IF NOT EXISTS {name} (id INT) USING parquet")
    return _last_read(session, name)


@query("r15_create_table_location", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def create_table_location(t: Tables) -> DataFrame:
    session, name, _ = _table(t)
    command(
        session,
        f"CREATE TABLE {name} (n_nationkey INT, n_name STRING, n_regionkey INT) "
        f"USING parquet LOCATION '{location(t.directory, 'nation')}'",
    )
    return _last_read(session, name)


@query(
    "r16_insert_into",
    "SELECT p_partkey AS id, p_name AS name FROM part UNION ALL SELECT -1, 'foo' UNION ALL SELECT -2, 'bar'",
)
def insert_into(t: Tables) -> DataFrame:
    session, name, folder = _table(t)
    register(session, t.directory, "part")
    command(session, f"CREATE TABLE {name} (id BIGINT, name STRING) USING parquet LOCATION '{folder}'")
    command(session, f"INSERT INTO {name} VALUES (-1, 'foo'), (-2, 'bar')")
    command(session, f"INSERT INTO {name} SELECT p_partkey, p_name FROM part")
    return _last_read(session, name)


@query(
    "r17_drop_table",
    "SELECT COUNT(*) AS n_rows, FALSE AS still_there FROM supplier",
)
def drop_table(t: Tables) -> DataFrame:
    session, name, folder = _table(t)
    register(session, t.directory, "supplier")
    command(session, f"CREATE TABLE {name} USING parquet LOCATION '{folder}' AS SELECT * FROM supplier")
    kept = session.table(name)
    command(session, f"DROP TABLE {name}")
    command(session, f"DROP TABLE IF EXISTS {name}")
    return kept.agg(n_rows().alias("n_rows"), F.lit(session.catalog.tableExists(name)).alias("still_there"))


def _last_read(session, name: str) -> DataFrame:
    """The rows of a table whose name goes away; its files lie outside the warehouse and stay."""
    df = session.table(name)
    command(session, f"DROP TABLE {name}")
    return df


@query(
    "r24_current_date",
    """
    SELECT o_orderpriority, COUNT(*) AS n_past FROM orders
    WHERE o_orderdate <= current_date GROUP BY o_orderpriority
    """,
)
def current_date(t: Tables) -> DataFrame:
    past = t.orders.where(F.col("o_orderdate") <= F.current_date())
    return past.groupBy("o_orderpriority").agg(n_rows().alias("n_past"))


@query("r25_three_level_name", "SELECT s_nationkey, COUNT(*) AS n FROM supplier GROUP BY s_nationkey")
def three_level_name(t: Tables) -> DataFrame:
    session, name, folder = _table(t)
    register(session, t.directory, "supplier")
    full_name = f"spark_catalog.default.{name}"
    command(session, f"CREATE TABLE {full_name} USING parquet LOCATION '{folder}' AS SELECT * FROM supplier")
    return _last_read(session, full_name).groupBy("s_nationkey").agg(n_rows().alias("n"))


@query("r26_default_catalog", "SELECT p_type, COUNT(*) AS n FROM part GROUP BY p_type")
def default_catalog(t: Tables) -> DataFrame:
    session, name, folder = _table(t)
    session.conf.set("spark.sql.defaultCatalog", "spark_catalog")
    register(session, t.directory, "part")
    command(session, f"CREATE TABLE {name} USING parquet LOCATION '{folder}' AS SELECT * FROM part")
    found = session.table(f"spark_catalog.{session.catalog.currentDatabase()}.{name}")
    command(session, f"DROP TABLE {name}")
    return found.groupBy("p_type").agg(n_rows().alias("n"))


@query("r27_path_source", "SELECT r_regionkey, r_name, n_name FROM region JOIN nation ON r_regionkey = n_regionkey")
def path_source(t: Tables) -> DataFrame:
    nation, region = (location(t.directory, name) for name in ("nation", "region"))
    return statement(
        t,
        f"SELECT r_regionkey, r_name, n_name FROM parquet.`{region}` JOIN parquet.`{nation}` "
        "ON r_regionkey = n_regionkey",
        "region",
    )


@query("r28_session_settings", "SELECT '17' AS partitions, COUNT(DISTINCT o_custkey) AS n_customers FROM orders")
def session_settings(t: Tables) -> DataFrame:
    session = isolated_session(t.spark, {"spark.sql.shuffle.partitions": "17"})
    setting = session.conf.get("spark.sql.shuffle.partitions")
    orders = session.read.parquet(location(t.directory, "orders"))
    return orders.agg(F.count_distinct("o_custkey").alias("n_customers")).withColumn(
        "partitions", F.lit(setting)
    )


@query("r30_empty_result", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 0")
def empty_result(t: Tables) -> DataFrame:
    return t.orders.where("o_totalprice < 0").select("o_orderkey", "o_totalprice")


@query(
    "r29_errors_surface",
    """
    SELECT * FROM (VALUES (0, 'TABLE_OR_VIEW_NOT_FOUND'), (1, 'PARSE_SYNTAX_ERROR'),
                          (2, 'DIVIDE_BY_ZERO')) AS e(idx, condition)
    WHERE (SELECT COUNT(*) FROM lineitem) > 0
    """,
)
def errors_surface(t: Tables) -> DataFrame:
    path = location(t.directory, "lineitem")
    outcomes = run_script(
        t.spark,
        [
            "SELECT * FROM there_is_no_such_table",
            "SELEC COUNT(*) FROM lineitem",
            f"SELECT l_quantity / (l_linenumber - l_linenumber) AS never FROM parquet.`{path}`",
        ],
        fresh_folder(t.spark, "errors"),
    )
    return outcomes.where("NOT success").select(
        "idx", F.substring_index("error", ":", 1).alias("condition")
    )
