"""Joins and subqueries.

Where a result is aggregated anyway, the many side is aggregated on the join key first: each task
reduces a key that holds much of the data to one row before the shuffle. Where single rows are
joined, the other side has one row per key, no key multiplies, and AQE splits the partition of a
hot key. No side is broadcast by hint unless its number of rows is fixed by the query itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tablewright.functions.fixpoint import reached
from tablewright.functions.intervals import within_before
from tablewright.functions.order_totals import totals_below
from tablewright.functions.skew import (
    SLICE,
    earlier_slices,
    over_keys,
    slice_window,
    with_carry,
)
from tablewright.functions.skew_join import full_outer_join as skew_full_outer_join
from tablewright.plans.helpers import n_rows, statement
from tablewright.plans.registry import Tables, query
from tablewright.session import isolated_session


@query(
    "p09_inner_join",
    """
    SELECT c_mktsegment, COUNT(*) AS n_orders, ROUND(SUM(o_totalprice), 2) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
    """,
)
def inner_join(t: Tables) -> DataFrame:
    per_customer = t.orders.groupBy("o_custkey").agg(
        n_rows().alias("n"), F.sum("o_totalprice").alias("total")
    )
    joined = per_customer.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(
        F.sum("n").alias("n_orders"), F.round(F.sum("total"), 2).alias("total")
    )


@query(
    "p09_inner_join_rows",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, p_brand, l_quantity
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10
    """,
)
def inner_join_rows(t: Tables) -> DataFrame:
    small = t.part.where("p_size < 10")
    joined = t.lineitem.join(small, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "p_brand", "l_quantity")


@query(
    "p10_left_outer_join",
    """
    SELECT c_custkey, c_name, COUNT(o_orderkey) AS n_urgent
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'
    GROUP BY c_custkey, c_name
    """,
)
def left_outer_join(t: Tables) -> DataFrame:
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(
        n_rows().alias("n")
    )
    joined = t.customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("n_urgent"))


@query(
    "p10_right_outer_join",
    """
    SELECT n_name, COUNT(s_suppkey) AS n_suppliers, ROUND(MAX(s_acctbal), 2) AS top
    FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name
    """,
)
def right_outer_join(t: Tables) -> DataFrame:
    per_nation = t.supplier.groupBy("s_nationkey").agg(
        n_rows().alias("n"), F.max("s_acctbal").alias("top")
    )
    joined = per_nation.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "right")
    return joined.select(
        "n_name", F.coalesce("n", F.lit(0)).alias("n_suppliers"), F.round("top", 2).alias("top")
    )


@query(
    "p10_full_outer_join",
    """
    SELECT coalesce(a.k, b.k) AS month, a.n AS n_ordered, b.n AS n_shipped
    FROM (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS k, COUNT(*) AS n FROM orders GROUP BY 1) a
    FULL JOIN (SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS k, COUNT(*) AS n FROM lineitem GROUP BY 1) b
    ON a.k = b.k
    """,
)
def full_outer_join(t: Tables) -> DataFrame:
    def per_month(df: DataFrame, column: str, name: str) -> DataFrame:
        month = F.date_trunc("month", column).cast("timestamp_ntz").alias("month")
        return df.groupBy(month).agg(n_rows().alias(name))

    ordered = per_month(t.orders, "o_orderdate", "n_ordered")
    return ordered.join(per_month(t.lineitem, "l_shipdate", "n_shipped"), "month", "full")


@query(
    "p10_full_outer_join_hot_keys",
    """
    SELECT c_custkey, s_suppkey, p_partkey
    FROM (SELECT c_custkey, s_suppkey, coalesce(c_nationkey, s_nationkey) AS nation
          FROM customer FULL JOIN supplier ON c_nationkey = s_nationkey)
    FULL JOIN part ON nation = p_size
    """,
)
def full_outer_join_hot_keys(t: Tables) -> DataFrame:
    """A key has many rows on both sides, and the second join has sizes beyond the nations."""
    people = skew_full_outer_join(
        t.customer.select("c_custkey", "c_nationkey"),
        t.supplier.select("s_suppkey", "s_nationkey"),
        [("c_nationkey", "s_nationkey")],
    ).select("c_custkey", "s_suppkey", F.coalesce("c_nationkey", "s_nationkey").alias("nation"))
    parts = t.part.select("p_partkey", "p_size")
    joined = skew_full_outer_join(people, parts, [("nation", "p_size")])
    return joined.select("c_custkey", "s_suppkey", "p_partkey")


@query(
    "p11_semi_join",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)
    """,
)
def semi_join(t: Tables) -> DataFrame:
    big = t.orders.where("o_totalprice > 400000").select("o_custkey").distinct()
    joined = t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return joined.select("c_custkey", "c_name")


@query(
    "p11_anti_join",
    """
    SELECT p_partkey, p_name FROM part
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)
    """,
)
def anti_join(t: Tables) -> DataFrame:
    bulk = t.lineitem.where("l_quantity > 45").select("l_partkey").distinct()
    joined = t.part.join(bulk, F.col("p_partkey") == F.col("l_partkey"), "left_anti")
    return joined.select("p_partkey", "p_name")


@query(
    "p12_cross_join",
    """
    SELECT c_custkey, ROUND(c_acctbal - mean, 4) AS above_mean
    FROM customer CROSS JOIN (SELECT AVG(c_acctbal) AS mean FROM customer)
    """,
)
def cross_join(t: Tables) -> DataFrame:
    """The other side is a global aggregate, which is one row at any scale."""
    mean = t.customer.agg(F.avg("c_acctbal").alias("mean"))
    joined = t.customer.crossJoin(F.broadcast(mean))
    return joined.select("c_custkey", F.round(F.col("c_acctbal") - F.col("mean"), 4).alias("above_mean"))


BANDS = "VALUES ('low', NULL, 50000), ('middle', 50000, 150000), ('high', 150000, 300000), ('top', 300000, NULL)"


@query(
    "p13_theta_join",
    f"""
    SELECT band, COUNT(*) AS n, MAX(o_totalprice) AS top
    FROM orders JOIN ({BANDS}) AS b(band, low, high)
      ON (low IS NULL OR o_totalprice >= low) AND (high IS NULL OR o_totalprice < high)
    GROUP BY band
    """,
)
def theta_join(t: Tables) -> DataFrame:
    """No equality to hash on: every order meets the four bands, of which it is in one.

    The first and the last band are open, so no price is outside.
    """
    bands = t.spark.sql(f"SELECT * FROM {BANDS} AS b(band, low, high)")
    price = F.col("o_totalprice")
    joined = t.orders.join(
        F.broadcast(bands),
        (F.col("low").isNull() | (price >= F.col("low")))
        & (F.col("high").isNull() | (price < F.col("high"))),
    )
    return joined.groupBy("band").agg(n_rows().alias("n"), F.max("o_totalprice").alias("top"))


@query(
    "p13_inequality_join",
    """
    SELECT c_custkey, COUNT(s_suppkey) AS n_below,
           SUM(s_acctbal::DECIMAL(15, 2))::DOUBLE AS balance_below
    FROM customer LEFT JOIN supplier ON s_acctbal < c_acctbal GROUP BY c_custkey
    """,
)
def inequality_join(t: Tables) -> DataFrame:
    """For every customer the suppliers of a smaller balance: no nested loop and no pairs."""
    balance = F.col("s_acctbal").cast("decimal(15,2)")
    sums = {"n": F.lit(1), "total": balance}
    joined = totals_below(
        t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", t.supplier, "s_acctbal", sums
    )
    return joined.select(
        "c_custkey",
        F.coalesce("n", F.lit(0)).alias("n_below"),
        F.col("total").cast("double").alias("balance_below"),
    )


@query(
    "p13_inequality_join_same_table",
    """
    SELECT a.s_suppkey, COUNT(b.s_suppkey) AS n_below,
           SUM(b.s_acctbal::DECIMAL(15, 2))::DOUBLE AS balance_below
    FROM supplier a LEFT JOIN supplier b ON b.s_acctbal < a.s_acctbal GROUP BY a.s_suppkey
    """,
)
def inequality_join_same_table(t: Tables) -> DataFrame:
    sums = {"n": F.lit(1), "total": F.col("s_acctbal").cast("decimal(15,2)")}
    suppliers = t.supplier.select("s_suppkey", "s_acctbal")
    joined = totals_below(suppliers, "s_acctbal", t.supplier, "s_acctbal", sums)
    return joined.select(
        "s_suppkey",
        F.coalesce("n", F.lit(0)).alias("n_below"),
        F.col("total").cast("double").alias("balance_below"),
    )


@query(
    "p14_interval_join",
    """
    SELECT o_orderpriority, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS total
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey
     AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 400 DAYS
    GROUP BY o_orderpriority
    """,
)
def interval_join(t: Tables) -> DataFrame:
    """An order key is unique among orders, so a line meets at most one interval."""
    start = F.col("o_orderdate")
    within = (
        (F.col("l_orderkey") == F.col("o_orderkey"))
        & (F.col("l_shipdate") >= start)
        & (F.col("l_shipdate") < start + F.expr("INTERVAL 400 DAYS"))
    )
    return t.orders.join(t.lineitem, within).groupBy("o_orderpriority").agg(
        n_rows().alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")
    )


@query(
    "p14_interval_join_repeated_keys",
    """
    SELECT e.event_id, COUNT(b.event_id) AS n_hour_before, MAX(b.value) AS top_hour_before
    FROM events e LEFT JOIN events b
      ON b.user_id = e.user_id AND b.ts >= e.ts - INTERVAL 1 HOUR AND b.ts < e.ts
    GROUP BY e.event_id
    """,
)
def interval_join_repeated_keys(t: Tables) -> DataFrame:
    """What each user did in the hour before each event; users repeat on both sides."""
    events = t.events.select("event_id", "user_id", "ts")
    earlier = t.events.select("user_id", "ts", "value")
    aggregates = {"n_hour_before": "count(r)", "top_hour_before": "max(r.value)"}
    joined = within_before(events, earlier, ["user_id"], "ts", "1 hour", aggregates)
    return joined.select("event_id", *aggregates)


@query(
    "p15_as_of_join",
    """
    SELECT p.event_id, p.user_id, p.ts,
           (SELECT MAX(v.ts) FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id
             AND (v.ts < p.ts OR (v.ts = p.ts AND v.event_id < p.event_id))) AS last_view
    FROM events p WHERE p.event_type = 'purchase'
    """,
)
def as_of_join(t: Tables) -> DataFrame:
    """The latest view before each purchase: one ordered pass over both, users cut if large."""
    keys, order = ["user_id"], ["ts", "event_id"]
    # A NULL user is no user: such rows have no view to find, as in an equality.
    view = F.when((F.col("event_type") == "view") & F.col("user_id").isNotNull(), F.col("ts"))

    def purchases(rows: DataFrame, part: Window) -> DataFrame:
        earlier = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("last_view", F.max(view).over(earlier)).where(
            "event_type = 'purchase'"
        )

    def plain(rows: DataFrame) -> DataFrame:
        return purchases(rows, Window.partitionBy(*keys))

    def sliced(rows: DataFrame) -> DataFrame:
        before = (
            rows.groupBy("user_id", SLICE)
            .agg(F.max(view).alias("last"))
            .select("user_id", SLICE, F.max("last").over(earlier_slices(keys)).alias("before"))
        )
        found = with_carry(purchases(rows, slice_window(keys)), before, keys)
        return found.withColumn("last_view", F.coalesce("last_view", "before")).drop(
            SLICE, "before"
        )

    events = t.events.where(F.col("event_type").isin("purchase", "view")).select(
        "event_id", "user_id", "ts", "event_type"
    )
    return over_keys(events, keys, order, plain, sliced).drop("event_type")


def _joined(t: Tables, hint: str) -> DataFrame:
    """Line counts per order status with one join strategy asked for."""
    per_order = t.lineitem.groupBy("l_orderkey").agg(n_rows().alias("n"))
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    joined = per_order.join(orders.hint(hint), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderstatus").agg(F.sum("n").alias("n_lines"))


LINES_PER_STATUS = """
    SELECT o_orderstatus, COUNT(*) AS n_lines
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus
    """


@query("p16_hint_sort_merge", LINES_PER_STATUS)
def hint_sort_merge(t: Tables) -> DataFrame:
    return _joined(t, "merge")


@query("p16_hint_shuffle_hash", LINES_PER_STATUS)
def hint_shuffle_hash(t: Tables) -> DataFrame:
    return _joined(t, "shuffle_hash")


FLAGS = "VALUES ('A', 'accepted'), ('N', 'none'), ('R', 'returned')"


@query(
    "p16_hint_broadcast",
    f"""
    SELECT label, COUNT(*) AS n, MAX(l_extendedprice) AS top
    FROM lineitem JOIN ({FLAGS}) AS f(flag, label) ON l_returnflag = flag GROUP BY label
    """,
)
def hint_broadcast(t: Tables) -> DataFrame:
    """The side that is broadcast is written in the query."""
    flags = t.spark.sql(f"SELECT * FROM {FLAGS} AS f(flag, label)")
    joined = t.lineitem.join(F.broadcast(flags), F.col("l_returnflag") == F.col("flag"))
    return joined.groupBy("label").agg(n_rows().alias("n"), F.max("l_extendedprice").alias("top"))


@query(
    "p17_lateral_join",
    """
    SELECT c_custkey, n, top FROM customer,
    LATERAL (SELECT COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders WHERE o_custkey = c_custkey)
    """,
)
def lateral_join(t: Tables) -> DataFrame:
    """Catalyst turns the correlated aggregate into one aggregate per key and a left join."""
    own = t.orders.where(F.col("o_custkey") == F.col("c_custkey").outer()).select(
        n_rows().alias("n"), F.max("o_totalprice").alias("top")
    )
    return t.customer.lateralJoin(own).select("c_custkey", "n", "top")


@query(
    "p18_scalar_subquery",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)",
)
def scalar_subquery(t: Tables) -> DataFrame:
    mean = t.orders.select(F.avg("o_totalprice")).scalar()
    return t.orders.where(F.col("o_totalprice") > mean * F.lit(1.5)).select("o_orderkey", "o_totalprice")


@query(
    "p18_exists",
    """
    SELECT o_orderpriority, COUNT(*) AS n FROM orders
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)
    GROUP BY o_orderpriority
    """,
)
def exists(t: Tables) -> DataFrame:
    """The inner keys are made distinct first: a hot one is one row per task in the shuffle."""
    return statement(
        t,
        "WITH bulk AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 49) "
        "SELECT o_orderpriority, COUNT(*) AS n FROM orders "
        "WHERE EXISTS (SELECT 1 FROM bulk WHERE l_orderkey = o_orderkey) "
        "GROUP BY o_orderpriority",
        "orders",
        "lineitem",
    )


@query(
    "p18_in_subquery",
    "SELECT COUNT(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#3')",
)
def in_subquery(t: Tables) -> DataFrame:
    brand = t.part.where("p_brand = 'Brand#3'").select("p_partkey")
    return t.lineitem.where(F.col("l_partkey").isin(brand)).agg(n_rows().alias("n"))


@query(
    "p18_not_in",
    """
    SELECT c_custkey FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)
    """,
)
def not_in(t: Tables) -> DataFrame:
    """``NOT IN`` with its rule for NULL spelled out, so that it stays a hash-able anti join.

    A NULL in the list makes the result empty; a NULL on the left is in the result only if the list
    is empty.
    """
    listed = t.orders.where("o_totalprice > 300000").select("o_custkey").distinct()
    n_listed = listed.select(n_rows()).scalar()
    nulls = listed.select(F.count_if(F.col("o_custkey").isNull())).scalar()
    known = t.customer.where((F.col("c_custkey").isNotNull() | (n_listed == 0)) & (nulls == 0))
    joined = known.join(listed, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return joined.select("c_custkey")


@query(
    "p19_cte",
    """
    WITH spend AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey),
         mean AS (SELECT AVG(total) AS m FROM spend)
    SELECT o_custkey, ROUND(total, 2) AS total FROM spend, mean WHERE total > m * 1.2::DOUBLE
    """,
)
def cte(t: Tables) -> DataFrame:
    return statement(
        t,
        "WITH spend AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey), "
        "mean AS (SELECT AVG(total) AS m FROM spend) "
        "SELECT o_custkey, ROUND(total, 2) AS total FROM spend WHERE total > (SELECT m * 1.2D FROM mean)",
        "orders",
    )


@query(
    "p19_recursive_cte",
    """
    WITH RECURSIVE quarters(start, stop) AS (
      SELECT date_trunc('quarter', MIN(o_orderdate))::TIMESTAMP, MAX(o_orderdate) FROM orders
      UNION ALL
      SELECT start + INTERVAL 3 MONTHS, stop FROM quarters WHERE start + INTERVAL 3 MONTHS <= stop),
    counted AS (SELECT date_trunc('quarter', o_orderdate)::TIMESTAMP AS q, COUNT(*) AS n FROM orders GROUP BY 1)
    SELECT start, coalesce(n, 0) AS n FROM quarters LEFT JOIN counted ON start = q
    """,
)
def recursive_cte(t: Tables) -> DataFrame:
    """A calendar of quarters from the first order to the last, and the orders in each.

    A recursion has one level per quarter; the limit is set beyond any calendar.
    """
    session = isolated_session(t.spark, {"spark.sql.cteRecursionLevelLimit": "100000"})
    return statement(
        Tables(session, t.directory),
        "WITH RECURSIVE quarters(start, stop) AS ("
        "SELECT CAST(date_trunc('quarter', MIN(o_orderdate)) AS TIMESTAMP_NTZ), MAX(o_orderdate) FROM orders "
        "UNION ALL "
        "SELECT start + INTERVAL 3 MONTHS, stop FROM quarters WHERE start + INTERVAL 3 MONTHS <= stop), "
        "counted AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP_NTZ) AS q, COUNT(*) AS n "
        "FROM orders GROUP BY 1) "
        "SELECT start, coalesce(n, 0) AS n FROM quarters LEFT JOIN counted ON start = q",
        "orders",
    )


@query(
    "p19_recursion_over_rows",
    """
    WITH RECURSIVE links AS (
      SELECT DISTINCT a.l_partkey AS source, b.l_partkey AS target
      FROM lineitem a JOIN lineitem b
        ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
    walk AS (
      SELECT DISTINCT p_partkey AS node, 0 AS round FROM part
      WHERE p_retailprice = (SELECT MAX(p_retailprice) FROM part)
      UNION
      SELECT target, round + 1 FROM walk JOIN links ON node = source WHERE round < 40)
    SELECT node, MIN(round) AS round FROM walk GROUP BY node
    """,
)
def recursion_over_rows(t: Tables) -> DataFrame:
    """Parts that the dearest part leads to, where a part leads to the one on the next line of an
    order, with the least number of steps."""
    here = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("source"))
    after = t.lineitem.select(
        "l_orderkey",
        (F.col("l_linenumber") - 1).alias("l_linenumber"),
        F.col("l_partkey").alias("target"),
    )
    links = here.join(after, ["l_orderkey", "l_linenumber"]).select("source", "target")
    dearest = t.part.select(F.max("p_retailprice")).scalar()
    seeds = t.part.where(F.col("p_retailprice") == dearest).select(F.col("p_partkey").alias("node"))
    return reached(links, seeds)
