"""Scalar functions over whole tables: row by row, without a shuffle unless they are counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablewright.plans.helpers import n_rows
from tablewright.plans.registry import Tables, query


@query(
    "p38_strings",
    r"""
    SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, substring(c_name, 10, 4) AS piece,
           length(c_name)::INTEGER AS len, c_name || '/' || c_mktsegment AS joined, trim('  ' || c_name || ' ') AS trimmed,
           replace(c_name, '#', '-') AS replaced, lpad(c_custkey::VARCHAR, 12, '0') AS padded,
           regexp_replace(c_name, '[0-9]', 'x', 'g') AS masked,
           regexp_extract(c_name, '([0-9]+)$', 1) AS digits
    FROM customer
    """,
)
def strings(t: Tables) -> DataFrame:
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return t.customer.select(
        "c_custkey",
        F.upper(name).alias("up"),
        F.lower(segment).alias("low"),
        F.substring(name, 10, 4).alias("piece"),
        F.length(name).alias("len"),
        F.concat(name, F.lit("/"), segment).alias("joined"),
        F.trim(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"),
        F.replace(name, F.lit("#"), F.lit("-")).alias("replaced"),
        F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("padded"),
        F.regexp_replace(name, "[0-9]", "x").alias("masked"),
        F.regexp_extract(name, "([0-9]+)$", 1).alias("digits"),
    )


@query(
    "p39_dates",
    """
    SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m,
           date_trunc('month', o_orderdate)::TIMESTAMP AS month_start,
           date_diff('day', TIMESTAMP '1995-01-01 00:00:00', o_orderdate)::INTEGER AS days,
           strftime(o_orderdate, '%Y-%m') AS label,
           o_orderdate::DATE + 30 AS due
    FROM orders
    """,
)
def dates(t: Tables) -> DataFrame:
    date = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        F.year(date).alias("y"),
        F.month(date).alias("m"),
        F.date_trunc("month", date).cast("timestamp_ntz").alias("month_start"),
        F.datediff(date, F.lit("1995-01-01").cast("date")).alias("days"),
        F.date_format(date, "yyyy-MM").alias("label"),
        F.date_add(date.cast("date"), 30).alias("due"),
    )


@query(
    "p40_math",
    """
    SELECT l_orderkey, l_linenumber, round(l_extendedprice, -2) AS hundreds, floor(l_tax * 100)::BIGINT AS low,
           ceil(l_quantity / 3)::BIGINT AS thirds, abs(l_discount - 0.05::DOUBLE) AS off, sqrt(l_quantity) AS root,
           power(l_quantity, 2) AS square, l_orderkey % 7 AS rest, l_orderkey // 7 AS whole,
           l_extendedprice / l_quantity AS unit
    FROM lineitem
    """,
)
def math(t: Tables) -> DataFrame:
    quantity, price = F.col("l_quantity"), F.col("l_extendedprice")
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.round(price, -2).alias("hundreds"),
        F.floor(F.col("l_tax") * 100).alias("low"),
        F.ceil(quantity / 3).alias("thirds"),
        F.abs(F.col("l_discount") - 0.05).alias("off"),
        F.sqrt(quantity).alias("root"),
        F.pow(quantity, 2).alias("square"),
        (F.col("l_orderkey") % 7).alias("rest"),
        F.expr("l_orderkey div 7").alias("whole"),
        (price / quantity).alias("unit"),
    )


@query(
    "p41_hashes_try_cast",
    """
    SELECT o_orderkey, md5(o_orderpriority) AS md5, sha256(o_orderpriority) AS sha,
           TRY_CAST(left(o_orderpriority, 1) AS INTEGER) AS level,
           TRY_CAST(o_orderstatus AS INTEGER) AS none
    FROM orders
    """,
)
def hashes_try_cast(t: Tables) -> DataFrame:
    priority = F.col("o_orderpriority")
    return t.orders.select(
        "o_orderkey",
        F.md5(priority).alias("md5"),
        F.sha2(priority, 256).alias("sha"),
        F.left(priority, F.lit(1)).try_cast("int").alias("level"),
        F.col("o_orderstatus").try_cast("int").alias("none"),
    )


@query(
    "p42_arrays",
    """
    SELECT vec_id, len(embedding)::INTEGER AS size, list_max(embedding)::DOUBLE AS top,
           embedding[1]::DOUBLE AS head,
           ROUND(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS squares
    FROM embeddings
    """,
)
def arrays(t: Tables) -> DataFrame:
    vector = F.col("embedding")
    squares = F.aggregate(
        vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return t.embeddings.select(
        "vec_id",
        F.size(vector).alias("size"),
        F.array_max(vector).cast("double").alias("top"),
        F.element_at(vector, 1).cast("double").alias("head"),
        F.round(squares, 6).alias("squares"),
    )


@query(
    "p42_explode",
    """
    SELECT lang, COUNT(*) AS n_words, COUNT(DISTINCT word) AS n_distinct FROM (
      SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents)
    WHERE word <> '' GROUP BY lang
    """,
)
def explode(t: Tables) -> DataFrame:
    """Words of the whole texts: a word's copies in one task are one row before the shuffle."""
    words = t.documents.select("lang", F.explode(F.split("text", " ")).alias("word"))
    counted = words.where("word <> ''").groupBy("lang", "word").agg(n_rows().alias("n"))
    return counted.groupBy("lang").agg(
        F.sum("n").alias("n_words"), n_rows().alias("n_distinct")
    )


@query(
    "p43_maps",
    """
    SELECT user_id, MAX(n) FILTER (WHERE event_type = 'click') AS clicks,
           COALESCE(MAX(n) FILTER (WHERE event_type = 'signup'), 0) AS signups,
           COUNT(*)::INTEGER AS n_types
    FROM (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY user_id, event_type)
    GROUP BY user_id
    """,
)
def maps(t: Tables) -> DataFrame:
    """A map per user from event type to count; it has as many entries as there are types."""
    counted = t.events.groupBy("user_id", "event_type").agg(n_rows().alias("n"))
    per_user = counted.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("by_type")
    )
    by_type = F.col("by_type")
    return per_user.select(
        "user_id",
        by_type["click"].alias("clicks"),
        F.coalesce(by_type["signup"], F.lit(0)).alias("signups"),
        F.size(by_type).alias("n_types"),
    )


@query(
    "p44_json_read",
    """
    SELECT event_id, json_extract_string(props, '$.k') AS k,
           CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS next
    FROM events
    """,
)
def json_read(t: Tables) -> DataFrame:
    parsed = F.from_json("props", "k int")
    return t.events.select(
        "event_id",
        F.get_json_object("props", "$.k").alias("k"),
        (parsed["k"] + 1).alias("next"),
    )


@query(
    "p44_json_write",
    """
    SELECT n_nationkey,
           to_json(struct_pack(n_nationkey := n_nationkey, n_name := n_name, n_regionkey := n_regionkey))::VARCHAR AS value
    FROM nation
    """,
)
def json_write(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.to_json(F.struct("*")).alias("value"))


@query(
    "p45_structs",
    """
    SELECT p_partkey, s.brand AS brand, s.size + 1 AS larger
    FROM (SELECT p_partkey, struct_pack(brand := p_brand, size := p_size) AS s FROM part)
    """,
)
def structs(t: Tables) -> DataFrame:
    packed = F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("s")
    return t.part.select("p_partkey", packed).select(
        "p_partkey", F.col("s.brand").alias("brand"), (F.col("s.size") + 1).alias("larger")
    )
