"""File formats, partitioned and bucketed tables, and table maintenance statements.

Everything is written to and read from the shared folder, with the schema given on read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from tablewright.operators.export import write_parquet
from tablewright.operators.render import rows_as_text
from tablewright.plans.helpers import command, n_rows, statement
from tablewright.plans.registry import Tables, query
from tablewright.session import isolated_session
from tablewright.sources.folders import fresh_folder
from tablewright.sources.tables import location, register


def _through(t: Tables, df: DataFrame, fmt: str, **options: str) -> DataFrame:
    """``df`` written in a format and read back."""
    path = fresh_folder(t.spark, fmt)
    df.write.format(fmt).options(**options).save(path)
    return t.spark.read.format(fmt).schema(df.schema).options(**options).load(path)


@query("p01_parquet", "SELECT * FROM orders")
def parquet(t: Tables) -> DataFrame:
    return _through(t, t.orders, "parquet")


@query("p01_orc", "SELECT * FROM orders")
def orc(t: Tables) -> DataFrame:
    return _through(t, t.orders, "orc")


@query("p01_json", "SELECT * FROM documents")
def json(t: Tables) -> DataFrame:
    return _through(t, t.documents, "json")


@query("p01_csv", "SELECT * FROM customer")
def csv(t: Tables) -> DataFrame:
    return _through(t, t.customer, "csv", header="true")


@query(
    "p01_text",
    """
    SELECT concat_ws(' | ', c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR,
                     c_acctbal::VARCHAR, c_mktsegment) AS value
    FROM customer
    """,
)
def text(t: Tables) -> DataFrame:
    """A text source has one column, so a whole row is a line of it."""
    return _through(t, rows_as_text(t.customer), "text")


@query("p01_xml", "SELECT * FROM supplier")
def xml(t: Tables) -> DataFrame:
    return _through(t, t.supplier, "xml", rowTag="supplier")


@query("p02_direct_file", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus")
def direct_file(t: Tables) -> DataFrame:
    path = location(t.directory, "orders")
    return statement(
        t, f"SELECT o_orderstatus, COUNT(*) AS n FROM parquet.`{path}` GROUP BY o_orderstatus", "region"
    )


@query("p03_partitioned", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def partitioned(t: Tables) -> DataFrame:
    """The read is pruned to the folder of one status."""
    path = fresh_folder(t.spark, "partitioned")
    write_parquet(t.orders, path, ["o_orderstatus"])
    stored = t.spark.read.schema(t.orders.schema).parquet(path)
    return stored.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query(
    "p03_bucketed",
    """
    SELECT o_orderstatus, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    GROUP BY o_orderstatus
    """,
)
def bucketed(t: Tables) -> DataFrame:
    """Both tables are bucketed by the key, so the merge join needs no shuffle.

    Lines are stored as a count per order: a key is one row on both sides and no bucket is hot.
    """
    session = isolated_session(t.spark)
    names = {}
    buckets = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    orders = t.orders.repartition(buckets, "o_orderkey")
    per_order = t.lineitem.groupBy("l_orderkey").agg(n_rows().alias("n"))
    for df, key in ((orders, "o_orderkey"), (per_order, "l_orderkey")):
        name = names[key] = f"b_{uuid.uuid4().hex}"
        folder = fresh_folder(t.spark, "bucketed")
        (
            df.write.bucketBy(buckets, key)
            .sortBy(key)
            .option("path", folder)
            .saveAsTable(name)
        )
    orders, lines = (session.table(names[key]) for key in ("o_orderkey", "l_orderkey"))
    joined = lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    counted = joined.groupBy("o_orderstatus").agg(F.sum("n").alias("n"))
    for name in names.values():
        command(session, f"DROP TABLE {name}")
    return counted


@query(
    "p04_table_maintenance",
    "SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS STRING) AS note FROM supplier WHERE s_acctbal > 0",
)
def table_maintenance(t: Tables) -> DataFrame:
    session = isolated_session(t.spark)
    register(session, t.directory, "supplier")
    name, folder = f"m_{uuid.uuid4().hex}", fresh_folder(t.spark, "maintained")
    command(session, f"CREATE TABLE {name} (id BIGINT, name STRING) USING parquet LOCATION '{folder}'")
    command(session, f"INSERT INTO {name} SELECT s_suppkey, s_name FROM supplier")
    command(session, f"INSERT OVERWRITE {name} SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
    command(session, f"ALTER TABLE {name} ADD COLUMN note STRING")
    command(session, f"ANALYZE TABLE {name} COMPUTE STATISTICS")
    command(session, f"CACHE LAZY TABLE {name}")
    command(session, f"UNCACHE TABLE {name}")
    df = session.table(name)
    command(session, f"DROP TABLE {name}")
    return df


@query(
    "p06_inline_values",
    """
    SELECT label, COUNT(*) AS n FROM orders
    JOIN (VALUES ('F', 'finished'), ('O', 'open'), ('P', 'pending')) AS v(code, label)
      ON o_orderstatus = code GROUP BY label
    """,
)
def inline_values(t: Tables) -> DataFrame:
    return statement(
        t,
        "SELECT label, SUM(n) AS n FROM (SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus) "
        "JOIN VALUES ('F', 'finished'), ('O', 'open'), ('P', 'pending') AS v(code, label) "
        "ON o_orderstatus = code GROUP BY label",
        "orders",
    )


@query(
    "p06_range",
    """
    SELECT COALESCE(q, b.range) AS bucket, COALESCE(n, 0) AS n FROM range(0, 60) b
    FULL JOIN (SELECT floor(l_quantity)::BIGINT AS q, COUNT(*) AS n FROM lineitem GROUP BY 1)
      ON q = b.range
    """,
)
def range_(t: Tables) -> DataFrame:
    """Lines per whole quantity: 0 to 59 always, other quantities and NULL where there are lines."""
    counted = t.lineitem.groupBy(F.floor("l_quantity").cast("bigint").alias("bucket")).agg(
        n_rows().alias("n")
    )
    buckets = t.spark.range(60).withColumnRenamed("id", "bucket")
    return buckets.join(counted, "bucket", "full").select(
        "bucket", F.coalesce("n", F.lit(0)).alias("n")
    )
