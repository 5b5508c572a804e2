"""The operators of this library over whole tables (B rows of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.operators import versions
from tablewright.operators.changes import as_of
from tablewright.operators.export import export_parquet, summarize
from tablewright.operators.governed import governed, governed_view
from tablewright.operators.merge import Delete, Insert, Merge, Update, merge_rows
from tablewright.operators.mutate import append_rows, delete_rows, update_rows
from tablewright.operators.profile import profile
from tablewright.operators.render import preview, rows_as_json, rows_as_text
from tablewright.operators.script import run_script
from tablewright.operators.statements import run
from tablewright.plans.helpers import statement
from tablewright.plans.registry import Tables, query
from tablewright.session import isolated_session
from tablewright.sources.folders import fresh_folder
from tablewright.sources.tables import location, register

# The flagship: net price of everything shipped up to a date.
PRICING_SUMMARY = """
SELECT l_returnflag, l_linestatus,
       ROUND(SUM(l_quantity), 2) AS sum_qty,
       ROUND(SUM(l_extendedprice), 2) AS sum_base_price,
       ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_net_price,
       ROUND(AVG(l_quantity), 6) AS avg_qty,
       ROUND(AVG(l_discount), 6) AS avg_disc,
       COUNT(*) AS n_rows
FROM lineitem
WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus
ORDER BY l_returnflag, l_linestatus
"""


@query("b01_execute_statement", PRICING_SUMMARY)
def execute_statement(t: Tables) -> DataFrame:
    return statement(t, PRICING_SUMMARY.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), "lineitem")


@query(
    "b02_statement_kind",
    """
    SELECT 0 AS idx, 'command' AS kind, CAST(NULL AS BIGINT) AS n_rows
    UNION ALL SELECT 1, 'rows', COUNT(*) FROM orders WHERE o_totalprice > 250000
    UNION ALL SELECT 2, 'rows', 1
    UNION ALL SELECT 3, 'error', NULL
    """,
)
def statement_kind(t: Tables) -> DataFrame:
    path = location(t.directory, "orders")
    outcomes = run_script(
        t.spark,
        [
            f"CREATE TEMPORARY VIEW dear AS SELECT * FROM parquet.`{path}` WHERE o_totalprice > 250000",
            "SELECT o_orderkey, o_totalprice FROM dear",
            "SELECT COUNT(*) AS n, MAX(o_totalprice) AS top FROM dear",
            "SELECT no_such_column FROM dear",
        ],
        fresh_folder(t.spark, "kinds"),
    )
    return outcomes.select("idx", "kind", "n_rows")


@query(
    "b03_preview",
    """
    SELECT o_orderkey, o_totalprice FROM orders
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000
    """,
)
def preview_rows(t: Tables) -> DataFrame:
    dearest = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey")
    return preview(dearest.select("o_orderkey", "o_totalprice"))


@query(
    "b04_rows_as_json",
    """
    SELECT CASE WHEN c_mktsegment = 'BUILDING'
                THEN to_json(struct_pack(c_custkey := c_custkey, c_name := c_name,
                                         c_nationkey := c_nationkey, c_acctbal := c_acctbal))
                ELSE to_json(struct_pack(c_custkey := c_custkey, c_name := c_name,
                                         c_nationkey := c_nationkey, c_acctbal := c_acctbal,
                                         c_mktsegment := c_mktsegment))
           END::VARCHAR AS value
    FROM customer
    """,
)
def json_rows(t: Tables) -> DataFrame:
    segment = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("c_mktsegment")
    return rows_as_json(t.customer.withColumn("c_mktsegment", segment))


@query(
    "b05_rows_as_text",
    """
    SELECT concat_ws(' | ', o_orderkey::VARCHAR, o_custkey::VARCHAR,
                     coalesce(nullif(o_orderstatus, 'P'), 'null'), o_totalprice::VARCHAR,
                     o_orderdate::VARCHAR, o_orderpriority) AS value
    FROM orders
    """,
)
def text_rows(t: Tables) -> DataFrame:
    status = F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus")
    return rows_as_text(t.orders.withColumn("o_orderstatus", status))


@query(
    "b06_profile",
    """
    WITH c AS (SELECT COUNT(*) AS n_rows, COUNT(o_orderkey) AS k, COUNT(o_totalprice) AS p,
                      COUNT(o_orderdate) AS d, COUNT(NULLIF(o_orderstatus, 'P')) AS s,
                      COUNT(o_custkey) AS u, COUNT(o_orderpriority) AS y FROM orders)
    SELECT 'o_orderkey' AS "column", 'bigint' AS type, TRUE AS nullable, n_rows, n_rows - k AS n_null FROM c
    UNION ALL SELECT 'o_custkey', 'bigint', TRUE, n_rows, n_rows - u FROM c
    UNION ALL SELECT 'o_orderpriority', 'string', TRUE, n_rows, n_rows - y FROM c
    UNION ALL SELECT 'o_totalprice', 'double', TRUE, n_rows, n_rows - p FROM c
    UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', TRUE, n_rows, n_rows - d FROM c
    UNION ALL SELECT 'o_orderstatus', 'string', TRUE, n_rows, n_rows - s FROM c
    """,
)
def profile_columns(t: Tables) -> DataFrame:
    status = F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus")
    return profile(t.orders.withColumn("o_orderstatus", status))


@query(
    "b07_export_parquet",
    """
    SELECT *, l_extendedprice * (1 - l_discount) AS net_price FROM lineitem
    """,
)
def export(t: Tables) -> DataFrame:
    net_price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = t.lineitem.withColumn("net_price", net_price)
    path = fresh_folder(t.spark, "export")
    export_parquet(lines, path)
    return t.spark.read.schema(lines.schema).parquet(path)


@query(
    "b08_export_manifest",
    """
    SELECT o_orderstatus AS part, COUNT(*) AS n_rows, TRUE AS has_bytes
    FROM orders GROUP BY o_orderstatus
    """,
)
def export_manifest(t: Tables) -> DataFrame:
    files = export_parquet(t.orders, fresh_folder(t.spark, "manifest"), ["o_orderstatus"])
    part = F.regexp_extract("file", "/o_orderstatus=([^/]*)/", 1).alias("part")
    return files.groupBy(part).agg(
        F.sum("n_rows").alias("n_rows"), (F.min("bytes") > 0).alias("has_bytes")
    )


@query(
    "b08_export_summary",
    "SELECT COUNT(*) AS n_rows, COUNT(*) > 0 AS has_files FROM customer",
)
def export_summary(t: Tables) -> DataFrame:
    files = export_parquet(t.customer, fresh_folder(t.spark, "summary"))
    return summarize(files).select("n_rows", (F.col("n_files") > 0).alias("has_files"))


@query(
    "b09_run_script",
    """
    SELECT 0 AS idx, 'command' AS kind, TRUE AS success, CAST(NULL AS BIGINT) AS n_rows
    UNION ALL SELECT 1, 'rows', TRUE, COUNT(*) FROM customer
    UNION ALL SELECT 2, 'rows', TRUE, COUNT(DISTINCT c_mktsegment) FROM customer
    UNION ALL SELECT 3, 'rows', FALSE, NULL
    UNION ALL SELECT 4, 'command', TRUE, NULL
    """,
)
def script(t: Tables) -> DataFrame:
    outcomes = run_script(
        t.spark,
        [
            f"CREATE TEMPORARY VIEW clients AS SELECT * FROM parquet.`{location(t.directory, 'customer')}`",
            "SELECT c_custkey, c_name FROM clients",
            "SELECT c_mktsegment, COUNT(*) AS n FROM clients GROUP BY c_mktsegment",
            "SELECT 1 / (c_custkey - c_custkey) AS never FROM clients",
            "DROP VIEW clients",
        ],
        fresh_folder(t.spark, "script"),
    )
    return outcomes.select("idx", "kind", "success", "n_rows")


@query(
    "b10_update",
    """
    SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority,
           CASE WHEN s = 'F' THEN 'closed' ELSE s END AS o_orderstatus,
           CASE WHEN s = 'F' THEN o_totalprice * 1.1 ELSE o_totalprice END AS o_totalprice
    FROM (SELECT *, NULLIF(o_orderstatus, 'P') AS s FROM orders)
    """,
)
def update(t: Tables) -> DataFrame:
    status = F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus")
    rows = t.orders.withColumn("o_orderstatus", status)
    changes = {"o_orderstatus": "'closed'", "o_totalprice": "o_totalprice * 1.1"}
    return update_rows(rows, changes, where="o_orderstatus = 'F'")


@query(
    "b10_update_versioned",
    """
    SELECT o_orderpriority, COUNT(*) AS n_rows,
           ROUND(SUM(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice * 2
                          ELSE o_totalprice END), 2) AS total
    FROM orders GROUP BY o_orderpriority
    """,
)
def update_versioned(t: Tables) -> DataFrame:
    root = _versioned(t, t.orders, ["o_orderpriority"])
    versions.update(
        t.spark,
        root,
        {"o_totalprice": "o_totalprice * 2"},
        where="o_orderpriority IN ('1-URGENT', '2-HIGH')",
    )
    return versions.read(t.spark, root).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "b11_delete",
    """
    SELECT o_orderkey, o_custkey, s AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM (SELECT *, NULLIF(o_orderstatus, 'P') AS s FROM orders)
    WHERE NOT coalesce(s = 'F' AND o_totalprice < 100000, FALSE)
    """,
)
def delete(t: Tables) -> DataFrame:
    status = F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus")
    rows = t.orders.withColumn("o_orderstatus", status)
    return delete_rows(rows, where="o_orderstatus = 'F' AND o_totalprice < 100000")


@query(
    "b11_delete_versioned",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_totalprice < 200000)
    """,
)
def delete_versioned(t: Tables) -> DataFrame:
    root = _versioned(t, t.orders, ["o_orderpriority"])
    versions.delete(t.spark, root, "o_orderpriority = '5-LOW' AND o_totalprice < 200000")
    return versions.read(t.spark, root)


@query(
    "b12_append",
    """
    SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier
    """,
)
def append(t: Tables) -> DataFrame:
    target = t.customer.selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance")
    rows = t.supplier.selectExpr("s_name AS name", "CAST(s_suppkey AS INT) AS id")
    return append_rows(target, rows)


@query(
    "b12_append_versioned",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
    UNION ALL
    SELECT l_orderkey, NULL, l_linestatus, l_extendedprice, l_shipdate, NULL FROM lineitem
    """,
)
def append_versioned(t: Tables) -> DataFrame:
    root = _versioned(t, t.orders)
    more = t.lineitem.selectExpr(
        "l_orderkey AS o_orderkey",
        "l_linestatus AS o_orderstatus",
        "l_extendedprice AS o_totalprice",
        "l_shipdate AS o_orderdate",
    )
    versions.append(t.spark, root, more)
    return versions.read(t.spark, root)


@query(
    "b13_time_travel",
    """
    SELECT 0 AS version, 0 AS n_rows, CAST(NULL AS DOUBLE) AS total
    UNION ALL SELECT 1, COUNT(*), ROUND(SUM(c_acctbal), 2) FROM customer
    UNION ALL SELECT 2, COUNT(*),
                     ROUND(SUM(CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_acctbal END), 2)
              FROM customer
    UNION ALL SELECT 3, COUNT(*),
                     ROUND(SUM(CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_acctbal END), 2)
              FROM customer WHERE c_mktsegment <> 'MACHINERY'
    """,
)
def time_travel(t: Tables) -> DataFrame:
    root = _versioned(t, t.customer, ["c_mktsegment"])
    versions.update(t.spark, root, {"c_acctbal": "0"}, "c_mktsegment = 'BUILDING'")
    versions.delete(t.spark, root, "c_mktsegment = 'MACHINERY'")
    per_version = [
        versions.read(t.spark, root, version).agg(
            F.lit(version).alias("version"),
            F.count(F.lit(1)).alias("n_rows"),
            F.round(F.sum("c_acctbal"), 2).alias("total"),
        )
        for version in range(4)
    ]
    first, *others = per_version
    for other in others:
        first = first.unionAll(other)
    return first


@query(
    "b13_as_of_changes",
    """
    SELECT user_id, event_id, event_type, value FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00')
    WHERE rn = 1 AND event_type <> 'error'
    """,
)
def as_of_changes(t: Tables) -> DataFrame:
    return as_of(
        t.events.select("user_id", "event_id", "ts", "event_type", "value"),
        keys=["user_id"],
        version=["ts", "event_id"],
        at="ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'",
        tombstone="event_type = 'error'",
    ).drop("ts")


@query(
    "b14_versioned_history",
    """
    SELECT 0 AS version, 'create' AS operation, 0 AS n_rows, 0 AS n_affected
    UNION ALL SELECT 1, 'append', COUNT(*), COUNT(*) FROM part
    UNION ALL SELECT 2, 'delete', COUNT(*) FILTER (WHERE p_size <= 25),
                     COUNT(*) FILTER (WHERE p_size > 25) FROM part
    """,
)
def versioned_history(t: Tables) -> DataFrame:
    root = _versioned(t, t.part, ["p_type"])
    versions.delete(t.spark, root, "p_size > 25")
    entries = versions.history(t.spark, root)
    return entries.select("version", "operation", "n_rows", "n_affected")


@query(
    "b15_row_filter",
    """
    SELECT c_custkey, c_name, c_acctbal FROM customer
    WHERE NULLIF(c_mktsegment, 'FURNITURE') <> 'BUILDING' AND c_acctbal > 0
    """,
)
def row_filter(t: Tables) -> DataFrame:
    visible = governed(t.customer, "nullif(c_mktsegment, 'FURNITURE') <> 'BUILDING'")
    return visible.where("c_acctbal > 0").select("c_custkey", "c_name", "c_acctbal")


@query(
    "b16_column_mask",
    """
    SELECT c_custkey, concat(left(c_name, 3), '***') AS c_name,
           CASE WHEN c_acctbal < 0 THEN NULL ELSE floor(c_acctbal / 1000) * 1000 END AS c_acctbal
    FROM customer WHERE c_mktsegment = 'BUILDING'
    """,
)
def column_mask(t: Tables) -> DataFrame:
    session = isolated_session(t.spark)
    register(session, t.directory, "customer")
    governed_view(
        session.table("customer"),
        "customer_for_readers",
        row_filter="c_mktsegment = 'BUILDING'",
        masks={
            "c_name": "concat(left(c_name, 3), '***')",
            "c_acctbal": "CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(floor(c_acctbal / 1000) * 1000 AS DOUBLE) END",
        },
    )
    return run(session, "SELECT c_custkey, c_name, c_acctbal FROM customer_for_readers").df


def _versioned(t: Tables, rows: DataFrame, partition_by: list[str] | None = None) -> str:
    """A new versioned table with ``rows`` as version 1."""
    root = fresh_folder(t.spark, "versioned")
    versions.create(t.spark, root, rows.schema, partition_by or [])
    versions.append(t.spark, root, rows)
    return root


# Orders as their lines say, and one opening order for every customer.
CHANGES = """
SELECT l_orderkey AS o_orderkey, l_orderkey AS o_custkey, COUNT(*) AS n_lines,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(15, 2))) AS DOUBLE) AS total,
       MIN(l_returnflag) AS flag
FROM lineitem GROUP BY l_orderkey
UNION ALL
SELECT -1 - c_custkey, c_custkey, 0, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'R' ELSE 'N' END FROM customer
"""

MERGED = f"""
    WITH s AS ({CHANGES})
    SELECT o.o_orderkey, o.o_custkey,
           CASE WHEN s.o_orderkey IS NULL AND o_orderstatus = 'O' THEN 'E' ELSE o_orderstatus END
               AS o_orderstatus,
           CASE WHEN n_lines >= 3 THEN total ELSE o_totalprice END AS o_totalprice,
           o_orderdate, o_orderpriority
    FROM orders o LEFT JOIN s USING (o_orderkey)
    WHERE NOT coalesce(flag = 'R' AND n_lines < 3, FALSE)
    UNION ALL
    SELECT o_orderkey, o_custkey, 'N', total, NULL, '5-LOW' FROM s WHERE o_orderkey < 0 AND flag = 'N'
    """


def _merge() -> Merge:
    return Merge(
        on=["o_orderkey"],
        matched=[
            Update({"o_totalprice": "source.total"}, "source.n_lines >= 3"),
            Delete("source.flag = 'R'"),
        ],
        not_matched=[
            Insert(
                {
                    "o_orderkey": "source.o_orderkey",
                    "o_custkey": "source.o_custkey",
                    "o_orderstatus": "'N'",
                    "o_totalprice": "source.total",
                    "o_orderpriority": "'5-LOW'",
                },
                "source.flag = 'N'",
            )
        ],
        not_matched_by_source=[Update({"o_orderstatus": "'E'"}, "target.o_orderstatus = 'O'")],
    )


@query("p52_merge", MERGED)
def merge(t: Tables) -> DataFrame:
    """``MERGE`` of whole orders with changes counted from all their lines."""
    changes = statement(t, CHANGES, "lineitem", "customer")
    return merge_rows(t.orders, changes, _merge())


@query("p52_merge_versioned", MERGED)
def merge_versioned(t: Tables) -> DataFrame:
    """The same on a versioned table: folders without a change are kept as they are."""
    root = _versioned(t, t.orders, ["o_orderpriority"])
    versions.merge(t.spark, root, statement(t, CHANGES, "lineitem", "customer"), _merge())
    return versions.read(t.spark, root)
