"""Window functions and time windows.

Ordered work per customer or user goes through ``functions.skew``: a key that holds much of the
data is cut into slices along the order, so no task has to hold or sort a whole hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tablewright.functions.intervals import within_before
from tablewright.functions.skew import (
    SLICE,
    earlier_slices,
    over_keys,
    running_totals,
    slice_window,
    with_carry,
    with_rows_before,
)
from tablewright.plans.helpers import n_rows
from tablewright.plans.registry import Tables, query


@query(
    "p29_ranking",
    """
    SELECT o_orderkey, ROW_NUMBER() OVER w AS row_number, RANK() OVER d AS rank,
           DENSE_RANK() OVER d AS dense_rank, NTILE(4) OVER w AS ntile,
           PERCENT_RANK() OVER d AS percent_rank, CUME_DIST() OVER d AS cume_dist
    FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey),
           d AS (PARTITION BY o_custkey ORDER BY o_orderdate)
    """,
)
def ranking(t: Tables) -> DataFrame:
    """All six from a row's number and, for each date of its key, the rows and dates before it.

    A date may be in several slices of a hot key, so its ranks come from counts per date.
    """
    keys, order = ["o_custkey"], ["o_orderdate", "o_orderkey"]

    def plain(orders: DataFrame) -> DataFrame:
        part = Window.partitionBy("o_custkey")
        by_date = part.orderBy("o_orderdate")
        return orders.select(
            "o_orderkey",
            F.row_number().over(part.orderBy(*order)).cast("bigint").alias("row_number"),
            F.rank().over(by_date).cast("bigint").alias("rank"),
            F.dense_rank().over(by_date).cast("bigint").alias("dense_rank"),
            F.count(F.lit(1)).over(by_date).alias("upto"),
            F.count(F.lit(1)).over(part).alias("total"),
        )

    def sliced(rows: DataFrame) -> DataFrame:
        numbered = running_totals(rows, keys, order, {"row_number": F.lit(1)})
        per_slice = rows.groupBy("o_custkey", SLICE, "o_orderdate").agg(n_rows().alias("n"))
        # A date of one key is one row per slice here; the key's dates are numbered in slices too.
        dates = per_slice.groupBy("o_custkey", "o_orderdate").agg(
            F.sum("n").alias("n"), F.min(SLICE).alias(SLICE)
        )
        counted = running_totals(
            dates, keys, ["o_orderdate"], {"upto": F.col("n"), "dense_rank": F.lit(1)}
        )
        totals = rows.groupBy("o_custkey").agg(n_rows().alias("total"))
        per_date = with_key_totals(counted, totals)
        same = F.col("o_custkey").eqNullSafe(F.col("_key")) & F.col("o_orderdate").eqNullSafe(
            F.col("_date")
        )
        return numbered.join(per_date, same).select(
            "o_orderkey", "row_number", "rank", "dense_rank", "upto", "total"
        )

    def with_key_totals(counted: DataFrame, totals: DataFrame) -> DataFrame:
        # One row per hot key, of which there are few.
        few = totals.withColumnRenamed("o_custkey", "_key")
        joined = counted.join(F.broadcast(few), F.col("o_custkey").eqNullSafe(F.col("_key")))
        return joined.select(
            "_key",
            F.col("o_orderdate").alias("_date"),
            (F.col("upto") - F.col("n") + 1).alias("rank"),
            "dense_rank",
            "upto",
            "total",
        )

    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    ranked = over_keys(orders, keys, order, plain, sliced)
    # ntile: the first ``total % 4`` buckets hold one row more than the others.
    total, number = F.col("total"), F.col("row_number")
    size, longer = F.floor(total / 4), total % 4
    in_longer = longer * (size + 1)
    ntile = F.when(number <= in_longer, F.floor((number - 1) / (size + 1)) + 1).otherwise(
        longer + F.floor((number - 1 - in_longer) / F.greatest(size, F.lit(1))) + 1
    )
    percent = F.when(total == 1, F.lit(0.0)).otherwise((F.col("rank") - 1) / (total - 1))
    return ranked.select(
        "o_orderkey",
        "row_number",
        "rank",
        "dense_rank",
        ntile.cast("bigint").alias("ntile"),
        percent.alias("percent_rank"),
        (F.col("upto") / total).alias("cume_dist"),
    )


@query(
    "p30_lag_lead_first",
    """
    SELECT event_id, LAG(value) OVER w AS previous, LEAD(value) OVER w AS next,
           FIRST_VALUE(value) OVER w AS first
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
    """,
)
def lag_lead_first(t: Tables) -> DataFrame:
    """Only the first and last row of a slice look beyond it, at the edges of its neighbours."""
    keys, order = ["user_id"], ["ts", "event_id"]

    def local(rows: DataFrame, part: Window) -> DataFrame:
        ordered = part.orderBy(*order)
        return rows.select(
            "*",
            F.row_number().over(ordered).alias("rn"),
            F.count(F.lit(1)).over(part).alias("rows"),
            F.lag("value").over(ordered).alias("previous"),
            F.lead("value").over(ordered).alias("next"),
            F.first("value").over(ordered).alias("first"),
        )

    def plain(rows: DataFrame) -> DataFrame:
        made = local(rows, Window.partitionBy("user_id"))
        return made.select("event_id", "previous", "next", "first")

    def sliced(rows: DataFrame) -> DataFrame:
        place = F.struct(*order)
        by_slice = Window.partitionBy("user_id").orderBy(SLICE)
        edges = (
            rows.groupBy("user_id", SLICE)
            .agg(F.min_by("value", place).alias("head"), F.max_by("value", place).alias("tail"))
            .select(
                "user_id",
                SLICE,
                F.lag("tail").over(by_slice).alias("tail_before"),
                F.lead("head").over(by_slice).alias("head_after"),
                F.first("head").over(by_slice).alias("very_first"),
            )
        )
        last = F.col("rn") == F.col("rows")
        return with_carry(local(rows, slice_window(keys)), edges, keys).select(
            "event_id",
            F.when(F.col("rn") == 1, F.col("tail_before"))
            .otherwise(F.col("previous"))
            .alias("previous"),
            F.when(last, F.col("head_after")).otherwise(F.col("next")).alias("next"),
            F.col("very_first").alias("first"),
        )

    events = t.events.select("event_id", "user_id", "ts", "value")
    return over_keys(events, keys, order, plain, sliced)


@query(
    "p31_rows_frame",
    """
    SELECT event_id, user_id, COUNT(*) OVER w AS n_so_far,
           (SUM(value::DECIMAL(12, 2)) OVER w)::DOUBLE AS spent_so_far
    FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    """,
)
def rows_frame(t: Tables) -> DataFrame:
    keys, order = ["user_id"], ["ts", "event_id"]
    values = {"n_so_far": F.lit(1), "spent_so_far": F.col("value").cast("decimal(12,2)")}

    def plain(rows: DataFrame) -> DataFrame:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({name: F.sum(v).over(upto) for name, v in values.items()})

    def sliced(rows: DataFrame) -> DataFrame:
        return running_totals(rows, keys, order, values).drop(SLICE)

    events = t.events.select("event_id", "user_id", "ts", "value")
    return over_keys(events, keys, order, plain, sliced).select(
        "event_id", "user_id", "n_so_far", F.col("spent_so_far").cast("double").alias("spent_so_far")
    )


@query(
    "p31_rows_frame_bounded",
    """
    SELECT event_id, user_id, COUNT(value) OVER w AS n_of_three,
           (SUM(value::DECIMAL(12, 2)) OVER w)::DOUBLE AS sum_of_three
    FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
    """,
)
def rows_frame_bounded(t: Tables) -> DataFrame:
    """A frame of three rows; a slice of a hot user also holds the two rows before it."""
    keys, order = ["user_id"], ["ts", "event_id"]

    def three(rows: DataFrame, part: Window) -> DataFrame:
        frame = part.orderBy(*order).rowsBetween(-2, Window.currentRow)
        total = F.sum(F.col("value").cast("decimal(12,2)")).over(frame)
        return rows.select(
            "*", F.count("value").over(frame).alias("n_of_three"), total.alias("sum_of_three")
        )

    def plain(rows: DataFrame) -> DataFrame:
        return three(rows, Window.partitionBy(*keys))

    def sliced(rows: DataFrame) -> DataFrame:
        with_halo = with_rows_before(rows, keys, order, 2, "halo")
        return three(with_halo, slice_window(keys)).where("NOT halo").drop("halo", SLICE)

    events = t.events.select("event_id", "user_id", "ts", "value")
    return over_keys(events, keys, order, plain, sliced).select(
        "event_id", "user_id", "n_of_three", F.col("sum_of_three").cast("double").alias("sum_of_three")
    )


@query(
    "p32_range_frame",
    """
    SELECT DISTINCT o_custkey, o_orderdate::DATE AS day,
           COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE
                          RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS n_in_week
    FROM orders
    """,
)
def range_frame(t: Tables) -> DataFrame:
    """Orders per customer in each of its order days and the seven days before; a day counts whole.

    Rows of one day share a frame, so days are counted first: a customer is as many rows as it
    has order days, however many orders it has.
    """
    daily = t.orders.groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("day")).agg(
        n_rows().alias("n")
    )
    week = "RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW"
    in_week = F.expr(f"sum(n) OVER (PARTITION BY o_custkey ORDER BY day {week})")
    return daily.select("o_custkey", "day", in_week.alias("n_in_week"))


@query(
    "p32_range_frame_times",
    """
    SELECT event_id, user_id, COUNT(*) OVER w AS n_in_week,
           (SUM(value::DECIMAL(12, 2)) OVER w)::DOUBLE AS spent_in_week
    FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts
                 RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)
    """,
)
def range_frame_times(t: Tables) -> DataFrame:
    """Seven days by the time of day: weeks are part of the key, each event in its own and the next."""
    events = t.events.select("event_id", "user_id", "ts")
    reached = t.events.select("user_id", "ts", F.col("value").cast("decimal(12,2)").alias("value"))
    aggregates = {"n_in_week": "count(r)", "spent_in_week": "sum(r.value)"}
    framed = within_before(events, reached, ["user_id"], "ts", "7 days", aggregates, upto_peers=True)
    return framed.select(
        "event_id", "user_id", "n_in_week", F.col("spent_in_week").cast("double").alias("spent_in_week")
    )


@query(
    "p33_top_k",
    """
    SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 25
    """,
)
def top_k(t: Tables) -> DataFrame:
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return t.lineitem.orderBy(*order).limit(25).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "p47_tumbling_window",
    """
    SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, COUNT(*) AS n,
           ROUND(SUM(value), 2) AS total
    FROM events GROUP BY 1, 2
    """,
)
def tumbling_window(t: Tables) -> DataFrame:
    hourly = t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(
        n_rows().alias("n"), F.round(F.sum("value"), 2).alias("total")
    )
    return hourly.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query(
    "p48_sliding_window",
    """
    SELECT start, COUNT(*) AS n, MAX(value) AS top FROM (
      SELECT time_bucket(INTERVAL '30 minutes', ts) AS start, value FROM events
      UNION ALL
      SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes', value FROM events)
    GROUP BY start
    """,
)
def sliding_window(t: Tables) -> DataFrame:
    """Half hours are counted first; an hour is then two of them, so no event is copied."""
    half_hours = t.events.groupBy(F.window("ts", "30 minutes").alias("half")).agg(
        n_rows().alias("n"), F.max("value").alias("top")
    )
    hours = half_hours.groupBy(
        F.window(F.col("half.start"), "1 hour", "30 minutes").alias("w")
    ).agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    return hours.select(F.col("w.start").alias("start"), "n", "top")


@query(
    "p49_session_window",
    """
    SELECT user_id, MIN(ts) AS start, MAX(ts) + INTERVAL '30 minutes' AS stop, COUNT(*) AS n FROM (
      SELECT *, SUM(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
        SELECT *, CASE WHEN ts <= LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                                  + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS opens FROM events))
    GROUP BY user_id, session
    """,
)
def session_window(t: Tables) -> DataFrame:
    """Sessions of events that lie at most 30 minutes apart.

    Events of a user in one half hour are always in one session, so each half hour is first
    reduced to its ends. A session window with a gap per row then joins them: it starts at the
    first event and closes 30 minutes after the last. The sorted part sees one row per user and
    half hour, whatever the number of events.
    """
    halves = t.events.groupBy("user_id", F.window("ts", "30 minutes").alias("half")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), n_rows().alias("n")
    )
    inside = F.expr("cast(last - first as interval second)").cast("decimal(18,6)")
    gap = F.make_interval(secs=inside + 1800)
    sessions = halves.groupBy("user_id", F.session_window("first", gap).alias("w")).agg(
        F.sum("n").alias("n")
    )
    return sessions.select(
        "user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n"
    )
