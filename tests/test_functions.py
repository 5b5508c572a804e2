"""Joins, frames and totals that are cut along an order or a time, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from tablewright.functions import percentiles, skew, skew_join
from tablewright.functions.distinct_totals import dense_numbers, rollup_distinct
from tablewright.functions.fixpoint import reached
from tablewright.functions.intervals import within_before
from tablewright.functions.order_totals import totals_below
from tablewright.functions.percentiles import exact_percentiles
from tablewright.functions.skew_join import full_outer_join
from tablewright.plans.catalogue import QUERIES
from tests.conftest import rows

DIRECTORY = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def events(spark):
    """A user with a third of the rows, bursts, equal times, NULL users and times."""
    return spark.sql(
        "SELECT id, CASE WHEN id % 3 = 0 THEN 5 WHEN id % 19 = 0 THEN NULL ELSE id % 40 END AS k, "
        "IF(id % 23 = 0, NULL, TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, "
        "CAST(id * 7919 % 3000 AS INT), id % 4 * 0.25)) AS ts, CAST(id % 100 AS DOUBLE) AS value "
        "FROM range(3000)"
    )


def test_rows_in_the_hour_before(spark, events):
    right = events.select("k", "ts", F.col("value").alias("v"), F.col("id").alias("other"))
    got = within_before(
        events, right, ["k"], "ts", "1 hour", {"n": "count(r)", "top": "max(r.v)", "total": "sum(r.v)"}
    )
    a, b = events.alias("a"), right.alias("b")
    near = F.expr("a.k = b.k AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 1 HOUR")
    want = a.join(b, near, "left").groupBy("a.id", "a.k", "a.ts", "a.value").agg(
        F.count("b.other"), F.max("b.v"), F.sum("b.v")
    )
    assert rows(got) == rows(want)
    assert within_before(events.limit(0), right, ["k"], "ts", "1 hour", {"n": "count(r)"}).count() == 0
    alone = within_before(events, right.limit(0), ["k"], "ts", "1 hour", {"n": "count(r)"})
    assert alone.agg(F.count("*"), F.sum("n")).first()[:] == (3000, 0)
    with pytest.raises(ValueError, match="reserved"):
        within_before(events.withColumn("r", F.lit(1)), right, ["k"], "ts", "1 hour", {})


def test_frame_of_an_interval(spark, events):
    got = within_before(
        events, events, ["k"], "ts", "7 minutes", {"n": "count(r)", "s": "sum(r.value)"}, upto_peers=True
    )
    frame = "(PARTITION BY k ORDER BY ts RANGE BETWEEN INTERVAL 7 MINUTES PRECEDING AND CURRENT ROW)"
    want = events.select("*", F.expr(f"count(*) OVER {frame}"), F.expr(f"sum(value) OVER {frame}"))
    assert rows(got) == rows(want)


def test_no_pairs_are_made(spark):
    for name in ("p14_interval_join_repeated_keys", "p32_range_frame_times"):
        assert "SortMergeJoin" not in plan(QUERIES[name](spark, DIRECTORY))
    for name in ("p13_inequality_join", "p13_inequality_join_same_table"):
        made = plan(QUERIES[name](spark, DIRECTORY))
        assert "NestedLoop" not in made and "Cartesian" not in made


def test_totals_below(spark):
    rng = random.Random(1)
    left = [(i, rng.choice([None, *range(30)])) for i in range(300)]
    right = [(rng.choice([None, *range(5, 25)]), rng.choice([None, 1, 2, 3])) for _ in range(500)]
    a = spark.createDataFrame(left, "id INT, v INT")
    b = spark.createDataFrame(right, "w INT, x INT")
    got = totals_below(a, "v", b, "w", {"n": F.lit(1), "total": F.col("x")})
    want = []
    for i, v in left:
        below = [x for w, x in right if v is not None and w is not None and w < v]
        known = [x for x in below if x is not None]
        want.append((i, v, len(below) or None, sum(known) if known else None))
    assert rows(got) == sorted(want, key=repr)
    assert rows(totals_below(a, "v", b.limit(0), "w", {"n": F.lit(1)})) == rows(
        a.withColumn("n", F.lit(None))
    )


@pytest.mark.parametrize("n", [1, 2, 5])
@pytest.mark.parametrize("parts", [3, 40])
def test_frames_over_slices(spark, monkeypatch, n, parts):
    monkeypatch.setattr(skew, "TASK_ROWS", 1)
    monkeypatch.setattr(skew, "PARTS", parts)
    df = spark.sql("SELECT id % 7 DIV 3 AS k, IF(id % 5 = 0, NULL, id * 31 % 50) AS t, id FROM range(400)")
    hot, n_slices = skew.hot_keys(df, ["k"])
    sliced = skew.slice_hot(df, ["k"], ["t", "id"], hot, n_slices)
    halo = skew.with_rows_before(sliced, ["k"], ["t", "id"], n, "halo")
    over = skew.slice_window(["k"]).orderBy("t", "id").rowsBetween(-n, 0)
    got = halo.withColumn("s", F.sum("id").over(over)).where("NOT halo").select("k", "t", "id", "s")
    plain = Window.partitionBy("k").orderBy("t", "id").rowsBetween(-n, 0)
    want = df.join(hot, "k").withColumn("s", F.sum("id").over(plain)).select("k", "t", "id", "s")
    assert rows(got) == rows(want)


def interpolated(values, fraction):
    ordered = sorted(values)
    h = fraction * (len(ordered) - 1)
    low, high = ordered[math.floor(h)], ordered[math.ceil(h)]
    return low if low == high else low + (high - low) * (h - math.floor(h))


SHAPES = {
    "even": lambda rng: rng.random(2000),
    "ties": lambda rng: np.array([1.0] * 900 + [2.0] * 1100),
    "far": lambda rng: np.concatenate([rng.random(1500), [1e300, -1e300, 1e-300, 0.0, math.inf, -math.inf]]),
    "powers": lambda rng: np.exp(rng.normal(0, 40, 2000)),
    "one": lambda rng: np.array([3.0]),
    "same": lambda rng: np.array([3.0] * 500),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_percentiles_by_rounds(spark, monkeypatch, shape):
    monkeypatch.setattr(skew, "TASK_ROWS", 7)
    monkeypatch.setattr(percentiles, "BINS", 16)
    values = SHAPES[shape](np.random.default_rng(3)).tolist()
    made = [(None, v) for v in values] + [("a", -v) for v in values[:50]] + [("b", None), ("a", None)]
    df = spark.createDataFrame(made, "k STRING, v DOUBLE").repartition(4)
    fractions = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    got = {(r.k, r.fraction): r.percentile for r in exact_percentiles(df, ["k"], "v", fractions).collect()}
    groups = {None: values, "a": [-v for v in values[:50]]}
    want = {(k, f): interpolated(v, f) for k, v in groups.items() for f in fractions}
    assert got.keys() == want.keys()
    assert all(got[key] == pytest.approx(want[key], rel=1e-12, nan_ok=True) for key in want)


def test_percentiles_keep_no_buffer(spark):
    made = plan(QUERIES["p25_percentiles_of_many_values"](spark, DIRECTORY))
    assert "percentile(" not in made and "ObjectHashAggregate" not in made


@pytest.mark.parametrize("bound", [1, 20, 10**6])
def test_full_outer_join(spark, monkeypatch, bound):
    """Keys that are heavy left, right, on both sides, or lack a side; NULLs; repeated rows."""
    monkeypatch.setattr(skew, "TASK_ROWS", bound)
    monkeypatch.setattr(skew, "PARTS", 40)
    a = [(1, i) for i in range(60)] + [(2, 7)] * 50 + [(3, 1), (4, 2)] + [(None, 3)] * 30
    a += [(6, i) for i in range(40)] + [(100 + i, i) for i in range(50)]
    b = [(1, i) for i in range(45)] + [(2, 1)] + [(3, i) for i in range(55)] + [(5, i) for i in range(70)]
    b += [(None, 4)] * 20 + [(125 + i, i) for i in range(50)]
    left, right = spark.createDataFrame(a, "k INT, x INT"), spark.createDataFrame(b, "m INT, y INT")
    got = full_outer_join(left, right, [("k", "m")])
    want = left.join(right, F.col("k") == F.col("m"), "full")
    assert got.columns == want.columns and rows(got) == rows(want)
    for one, other in ((left.limit(0), right), (left, right.limit(0))):
        want = one.join(other, F.col("k") == F.col("m"), "full")
        assert rows(full_outer_join(one, other, [("k", "m")])) == rows(want)
    with pytest.raises(ValueError, match="columns of both sides: k"):
        full_outer_join(left, left, [("k", "k")])


def test_tasks_of_a_key_that_is_hot_on_both_sides_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_ROWS", 100)
    monkeypatch.setattr(skew, "PARTS", 100)
    left = spark.sql("SELECT IF(id % 3 = 0, 5, id) AS k, id AS x FROM range(3000)")
    right = spark.sql("SELECT IF(id % 3 = 0, 5, id) AS m, id AS y FROM range(900)")
    heavy = skew_join.heavy_keys([left, right], [["k"], ["m"]])
    assert [tuple(r) for r in heavy.collect()] == [(5, 11, 4)]
    cells = skew_join._dealt(left, ["k"], heavy, 0).groupBy(*skew_join.SALTS).count().collect()
    assert len(cells) == 44 and max(r["count"] for r in cells) < 200
    assert full_outer_join(left, right, [("k", "m")]).count() == 1001 * 301 + 1999


@pytest.mark.parametrize("pairs", [1, 7, 500])
def test_full_outer_join_of_keys_with_many_pairs(spark, monkeypatch, pairs):
    """Few rows, so that no key is heavy by them; repeated rows, NULLs, keys that one side lacks."""
    monkeypatch.setattr(skew_join, "TASK_PAIRS", pairs)
    a = [(k, i) for k in range(5) for i in range(30)] + [(7, 7)] * 20 + [(None, 1), (9, 1)]
    b = [(k, i) for k in range(2, 8) for i in range(25)] + [(0, 1), (8, 1), (None, 2)]
    left, right = spark.createDataFrame(a, "k INT, x INT"), spark.createDataFrame(b, "m BIGINT, y INT")
    want = left.join(right, F.col("k") == F.col("m"), "full")
    assert rows(full_outer_join(left, right, [("k", "m")])) == rows(want)
    some = full_outer_join(left.where("k > 100"), right, [("k", "m")])
    assert rows(some) == rows(left.where("k > 100").join(right, F.col("k") == F.col("m"), "full"))


def test_pairs_of_keys_with_few_rows_are_bounded(spark):
    """Six million pairs of 4,000 and 3,000 rows, and half a million each of eight more keys."""
    left = spark.range(4000).selectExpr("id % 2 AS k", "id AS x")
    right = spark.range(3000).selectExpr("id % 2 AS m", "id AS y")
    left = left.unionAll(spark.range(5600).selectExpr("2 + id % 8 AS k", "id AS x"))
    right = right.unionAll(spark.range(5600).selectExpr("2 + id % 8 AS m", "id AS y"))
    joined = full_outer_join(left, right, [("k", "m")])
    tasks = joined.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in tasks) == 2 * 2000 * 1500 + 8 * 700 * 700
    assert max(r.n for r in tasks) < 3_500_000


@pytest.mark.parametrize("kind", ["INT", "BIGINT"])
def test_copies_for_the_grid_are_shuffled(spark, kind):
    """A few rows become many copies; their size in a file would let Spark broadcast them."""
    left = spark.range(40000).selectExpr(f"CAST(id % 2 AS {kind}) AS k", "id AS x")
    right = spark.range(400).selectExpr("id % 2 AS m", "id AS y")
    joined = full_outer_join(left, right, [("k", "m")])
    joins = [line for line in plan(joined).split("\n") if "Join" in line and "__left_salt" in line]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0]
    tasks = joined.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in tasks) == 2 * 20000 * 200
    assert max(r.n for r in tasks) < 3_500_000
    sums = [joined.where("k = m").agg(F.sum(c)).first()[0] for c in "xy"]
    assert sums == [200 * sum(range(40000)), 20000 * sum(range(400))]


def test_reached(spark):
    links = [(i, i + 1) for i in range(30)] + [(0, 10), (5, 5), (None, 3), (3, None), (50, 51), (31, 0)]
    df = spark.createDataFrame(links, "source INT, target INT")
    seeds = spark.createDataFrame([(0,), (0,), (None,), (99,)], "node INT")
    got = dict(map(tuple, reached(df, seeds).collect()))
    want = {0: 0, 99: 0} | {i: i for i in range(1, 10)} | {10 + i: 1 + i for i in range(21)}
    assert got == want
    assert max(r.round for r in reached(df, seeds, most_rounds=4).collect()) == 4
    assert reached(df, seeds.limit(0)).collect() == []
    assert dict(map(tuple, reached(df.limit(0), seeds).collect())) == {0: 0, 99: 0}


@pytest.mark.parametrize("dense", [True, False])
def test_distinct_under_rollup(spark, dense):
    df = spark.sql(
        "SELECT IF(id % 11 = 0, NULL, id % 3) AS a, id % 4 AS b, IF(id % 7 = 0, NULL, id * 13 % 90000) AS v "
        "FROM range(60000)"
    )
    number = F.col("v") if dense else None
    got = rollup_distinct(df, ["a", "b"], "v", "n", number)
    want = df.rollup("a", "b").agg(
        (F.grouping("a") + F.grouping("b")).cast("int").alias("level"), F.count_distinct("v").alias("n")
    )
    assert rows(got) == rows(want.select(*got.columns))


def test_dense_numbers(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("z",)], "v STRING")
    assert dict(map(tuple, dense_numbers(df, "v").collect())) == {"a": 0, "b": 1, "z": 2}
