"""Set operations and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.plans.helpers import n_rows
from tablewright.plans.registry import Tables, query


@query(
    "p07_predicates",
    """
    SELECT o_orderkey,
           CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle'
                ELSE 'low' END AS band,
           COALESCE(NULLIF(o_orderstatus, 'P'), 'none') AS status
    FROM orders
    WHERE (o_orderpriority LIKE '%HIGH' OR o_orderpriority LIKE '1-%') AND NOT o_orderstatus = 'F'
    """,
)
def predicates(t: Tables) -> DataFrame:
    priority, price = F.col("o_orderpriority"), F.col("o_totalprice")
    chosen = (priority.like("%HIGH") | priority.like("1-%")) & ~(F.col("o_orderstatus") == "F")
    return t.orders.where(chosen).select(
        "o_orderkey",
        F.when(price > 300000, "high").when(price > 100000, "middle").otherwise("low").alias("band"),
        F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("none")).alias("status"),
    )


@query("p08_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(t: Tables) -> DataFrame:
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query(
    "p34_union_all",
    """
    SELECT nation, COUNT(*) AS n FROM (
      SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier)
    GROUP BY nation
    """,
)
def union_all(t: Tables) -> DataFrame:
    customers = t.customer.select(F.col("c_nationkey").alias("nation"))
    return customers.union(t.supplier.select("s_nationkey")).groupBy("nation").agg(n_rows().alias("n"))


@query(
    "p35_union",
    "SELECT o_orderkey AS id FROM orders UNION SELECT l_orderkey FROM lineitem",
)
def union(t: Tables) -> DataFrame:
    orders = t.orders.select(F.col("o_orderkey").alias("id"))
    return orders.union(t.lineitem.select("l_orderkey")).distinct()


@query(
    "p36_intersect",
    "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier",
)
def intersect(t: Tables) -> DataFrame:
    """Both sides are made distinct before the shuffle, so a hot value is one row per task."""
    customers = t.customer.select(F.col("c_nationkey").alias("nation")).distinct()
    return customers.intersect(t.supplier.select("s_nationkey").distinct())


@query(
    "p37_except",
    "SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45",
)
def except_(t: Tables) -> DataFrame:
    """Both sides are made distinct before the shuffle, so a hot value is one row per task."""
    parts = t.part.select(F.col("p_partkey").alias("id")).distinct()
    return parts.subtract(t.lineitem.where("l_quantity > 45").select("l_partkey").distinct())


@query(
    "p37_except_all",
    """
    SELECT nation, COUNT(*) AS n FROM (
      SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)
    GROUP BY nation
    """,
)
def except_all(t: Tables) -> DataFrame:
    """Rows left of each value, as a number: those of the left less those of the right."""
    left = t.customer.select(F.col("c_nationkey").alias("nation"), F.lit(1).alias("one"))
    right = t.supplier.select("s_nationkey", F.lit(-1))
    return left.unionAll(right).groupBy("nation").agg(F.sum("one").alias("n")).where("n > 0")


@query(
    "p46_null_order",
    """
    SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS status FROM orders
    ORDER BY NULLIF(o_orderstatus, 'P') ASC NULLS LAST, o_orderkey
    """,
)
def null_order(t: Tables) -> DataFrame:
    status = F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status")
    return t.orders.select("o_orderkey", status).orderBy(
        F.asc_nulls_last("status"), "o_orderkey"
    )


@query(
    "p46_nulls_first",
    """
    SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS status FROM orders
    ORDER BY NULLIF(o_orderstatus, 'P') ASC NULLS FIRST, o_orderkey DESC
    """,
)
def nulls_first(t: Tables) -> DataFrame:
    status = F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status")
    return t.orders.select("o_orderkey", status).orderBy(
        F.asc_nulls_first("status"), F.desc("o_orderkey")
    )
