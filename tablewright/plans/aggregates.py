"""Grouping and aggregate queries. All reduce their rows before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.functions.distinct_totals import (
    kept_sketches,
    merged_estimates,
    rollup_distinct,
)
from tablewright.functions.percentiles import exact_percentiles
from tablewright.plans.helpers import n_rows, rounded_avg, rounded_sum, statement
from tablewright.plans.registry import Tables, query


@query(
    "p20_group_by",
    """
    SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS total,
           ROUND(AVG(l_extendedprice), 4) AS mean, MIN(l_shipdate) AS first, MAX(l_shipdate) AS last
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
)
def group_by(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        n_rows().alias("n"),
        rounded_sum("l_quantity").alias("total"),
        rounded_avg("l_extendedprice", 4).alias("mean"),
        F.min("l_shipdate").alias("first"),
        F.max("l_shipdate").alias("last"),
    )


@query(
    "p21_having",
    "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10",
)
def having(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(n_rows().alias("n")).where("n > 10")


@query(
    "p22_count_distinct",
    """
    SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS n_customers FROM orders
    GROUP BY o_orderpriority
    """,
)
def count_distinct(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(
        F.count_distinct("o_custkey").alias("n_customers")
    )


@query(
    "p23_filtered_aggregate",
    """
    SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n_closed,
           MAX(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS top_open
    FROM orders GROUP BY o_orderpriority
    """,
)
def filtered_aggregate(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("n_closed"),
        F.expr("max(o_totalprice) FILTER (WHERE o_orderstatus = 'O')").alias("top_open"),
    )


@query(
    "p24_rollup",
    """
    SELECT l_returnflag, l_linestatus, GROUPING(l_linestatus) AS rolled, COUNT(*) AS n
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
    """,
)
def rollup(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(
        F.grouping("l_linestatus").cast("bigint").alias("rolled"), n_rows().alias("n")
    )


@query(
    "p24_cube",
    """
    SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS total
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
    """,
)
def cube(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(
        n_rows().alias("n"), rounded_sum("l_quantity").alias("total")
    )


@query(
    "p24_grouping_sets",
    """
    SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders
    GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())
    """,
)
def grouping_sets(t: Tables) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return t.orders.groupingSets([[status], [priority], []], status, priority).agg(
        n_rows().alias("n")
    )


@query(
    "p24_distinct_under_rollup",
    """
    SELECT o_orderstatus, o_orderpriority,
           (GROUPING(o_orderstatus) + GROUPING(o_orderpriority))::INTEGER AS level,
           COUNT(DISTINCT o_custkey) AS n_customers
    FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
    """,
)
def distinct_under_rollup(t: Tables) -> DataFrame:
    """Bitmaps of customers merged up the levels; their keys are dense numbers already."""
    levels = ["o_orderstatus", "o_orderpriority"]
    return rollup_distinct(t.orders, levels, "o_custkey", "n_customers", F.col("o_custkey"))


@query(
    "p24_distinct_prices_under_rollup",
    """
    SELECT l_returnflag, l_linestatus,
           (GROUPING(l_returnflag) + GROUPING(l_linestatus))::INTEGER AS level,
           COUNT(DISTINCT l_extendedprice) AS n_prices
    FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
    """,
)
def distinct_prices_under_rollup(t: Tables) -> DataFrame:
    """The same for values that are no dense numbers: they are numbered first."""
    levels = ["l_returnflag", "l_linestatus"]
    return rollup_distinct(t.lineitem, levels, "l_extendedprice", "n_prices")


@query(
    "p25_statistics",
    """
    SELECT event_type, ROUND(STDDEV(value), 6) AS sd, ROUND(VAR_SAMP(value), 4) AS var,
           ROUND(CORR(value, user_id), 6) AS corr, ROUND(COVAR_POP(value, user_id), 4) AS cov
    FROM events GROUP BY event_type
    """,
)
def statistics(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(
        F.round(F.stddev("value"), 6).alias("sd"),
        F.round(F.var_samp("value"), 4).alias("var"),
        F.round(F.corr("value", "user_id"), 6).alias("corr"),
        F.round(F.covar_pop("value", "user_id"), 4).alias("cov"),
    )


@query(
    "p25_percentiles",
    """
    SELECT l_returnflag, MEDIAN(l_quantity) AS middle,
           ROUND(QUANTILE_CONT(l_quantity, 0.9), 6) AS p90
    FROM lineitem GROUP BY l_returnflag
    """,
)
def percentiles(t: Tables) -> DataFrame:
    """Exact percentiles from the count of each value, not from the values.

    A quantity is a whole number from 1 to 50, so a group is 50 weighted rows at any scale.
    """
    weighted = t.lineitem.groupBy("l_returnflag", "l_quantity").agg(n_rows().alias("n"))
    return weighted.groupBy("l_returnflag").agg(
        F.percentile("l_quantity", 0.5, F.col("n")).alias("middle"),
        F.round(F.percentile("l_quantity", 0.9, F.col("n")), 6).alias("p90"),
    )


@query(
    "p25_percentiles_of_many_values",
    """
    SELECT l_returnflag, ROUND(MEDIAN(l_extendedprice), 4) AS middle,
           ROUND(QUANTILE_CONT(l_extendedprice, 0.9), 4) AS p90
    FROM lineitem GROUP BY l_returnflag
    """,
)
def percentiles_of_many_values(t: Tables) -> DataFrame:
    """Prices hardly repeat, so they are selected by rounds of counting and not kept in a buffer."""
    found = exact_percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", [0.5, 0.9])
    at = lambda f: F.round(F.max(F.when(F.col("fraction") == f, F.col("percentile"))), 4)
    return found.groupBy("l_returnflag").agg(at(0.5).alias("middle"), at(0.9).alias("p90"))


@query(
    "p26_approx_count_distinct",
    """
    SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS exact, TRUE AS close
    FROM orders GROUP BY o_orderstatus
    """,
)
def approx_count_distinct(t: Tables) -> DataFrame:
    """The estimate itself is Spark's own; compared is that it is within a tenth of the count.

    Two aggregates: in one, the exact count would split the sketch by customer.
    """
    exact = t.orders.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("exact"))
    estimates = t.orders.groupBy("o_orderstatus").agg(
        F.approx_count_distinct("o_custkey", 0.02).alias("estimate")
    )
    close = F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact") * 0.1
    return exact.join(estimates, "o_orderstatus").select(
        "o_orderstatus", "exact", close.alias("close")
    )


@query(
    "p26_kept_sketches",
    """
    SELECT date_trunc('quarter', o_orderdate)::TIMESTAMP AS quarter,
           COUNT(DISTINCT o_custkey) AS exact, TRUE AS close
    FROM orders GROUP BY 1
    """,
)
def sketches_that_are_kept(t: Tables) -> DataFrame:
    """Sketches are made and stored by month; quarters are merged from them and not counted again.
    Compared is that the estimate is within a tenth of the count."""
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")
    quarter = lambda c: F.date_trunc("quarter", c).cast("timestamp_ntz").alias("quarter")
    monthly = kept_sketches(t.orders, [month], "o_custkey")
    estimates = merged_estimates(monthly, [quarter("month")], "estimate")
    exact = t.orders.groupBy(quarter("o_orderdate")).agg(F.count_distinct("o_custkey").alias("exact"))
    close = F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact") * 0.1
    return exact.join(estimates, "quarter").select("quarter", "exact", close.alias("close"))


@query(
    "p27_bool_aggregates",
    """
    SELECT user_id, BOOL_OR(event_type = 'error') AS any_error, BOOL_AND(value < 100) AS all_small
    FROM events GROUP BY user_id
    """,
)
def bool_aggregates(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(
        F.bool_or(F.col("event_type") == "error").alias("any_error"),
        F.bool_and(F.col("value") < 100).alias("all_small"),
    )


@query(
    "p27_collect_list",
    """
    SELECT user_id, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS counts
    FROM (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY user_id, event_type)
    GROUP BY user_id
    """,
)
def collect_list(t: Tables) -> DataFrame:
    """Lists are made of counted types, not of events: a user has as many entries as there are types."""
    counted = t.events.groupBy("user_id", "event_type").agg(n_rows().alias("n"))
    entry = F.concat_ws(":", "event_type", "n")
    return counted.groupBy("user_id").agg(
        F.array_join(F.sort_array(F.collect_list(entry)), ",").alias("counts")
    )


@query(
    "p28_pivot",
    """
    SELECT l_returnflag, SUM(l_quantity) FILTER (WHERE l_linestatus = 'F') AS F,
           SUM(l_quantity) FILTER (WHERE l_linestatus = 'O') AS O,
           SUM(l_quantity) FILTER (WHERE l_linestatus IS NULL OR l_linestatus NOT IN ('F', 'O')) AS other
    FROM lineitem GROUP BY l_returnflag
    """,
)
def pivot(t: Tables) -> DataFrame:
    """The list of columns is the schema; what is not in it is summed under ``other``."""
    status = F.col("l_linestatus")
    named = F.when(status.isin("F", "O"), status).otherwise("other").alias("status")
    lines = t.lineitem.select("l_returnflag", "l_quantity", named)
    return lines.groupBy("l_returnflag").pivot("status", ["F", "O", "other"]).sum("l_quantity")


@query(
    "p28_unpivot",
    """
    SELECT measure, COUNT(*) AS n, ROUND(SUM(amount), 2) AS total FROM (
      SELECT 'l_discount' AS measure, l_discount AS amount FROM lineitem
      UNION ALL SELECT 'l_tax', l_tax FROM lineitem) GROUP BY measure
    """,
)
def unpivot(t: Tables) -> DataFrame:
    long = t.lineitem.unpivot(["l_orderkey"], ["l_discount", "l_tax"], "measure", "amount")
    return long.groupBy("measure").agg(n_rows().alias("n"), rounded_sum("amount").alias("total"))


@query(
    "p20_group_by_sql",
    """
    SELECT year(o_orderdate)::INTEGER AS year, o_orderstatus, COUNT(*) AS n, MIN(o_totalprice) AS low
    FROM orders GROUP BY 1, 2
    """,
)
def group_by_sql(t: Tables) -> DataFrame:
    return statement(
        t,
        "SELECT year(o_orderdate) AS year, o_orderstatus, COUNT(*) AS n, MIN(o_totalprice) AS low "
        "FROM orders GROUP BY ALL",
        "orders",
    )
