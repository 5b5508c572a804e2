"""MERGE: clauses, NULL and repeated keys, types, and versions."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tablewright.operators import versions
from tablewright.operators.merge import (
    Delete,
    Insert,
    Merge,
    Update,
    added_rows,
    merge_rows,
    merged_rows,
    repeated_keys,
)
from tablewright.session import isolated_session
from tests.conftest import rows

TARGET = "id INT, name STRING, amount DOUBLE"


@pytest.fixture
def target(spark):
    return spark.createDataFrame(
        [(1, "a", 1.0), (2, "b", 2.0), (2, "bb", 2.5), (3, "c", 3.0), (None, "n", 0.0)], TARGET
    )


@pytest.fixture
def source(spark):
    return spark.createDataFrame(
        [(1, 10.0, False), (2, 20.0, True), (4, 40.0, False), (4, 41.0, True), (None, 9.0, False)],
        "id BIGINT, amount DOUBLE, gone BOOLEAN",
    )


def test_update_delete_insert(target, source):
    merge = Merge(
        ["id"],
        matched=[Delete("source.gone"), Update({"amount": "target.amount + source.amount"})],
        not_matched=[Insert(condition="NOT source.gone")],
    )
    assert rows(merge_rows(target, source, merge)) == rows_of(
        [(1, "a", 11.0), (3, "c", 3.0), (None, "n", 0.0), (4, None, 40.0), (None, None, 9.0)]
    )


def rows_of(found):
    return sorted(found, key=repr)


def test_star_takes_the_columns_that_the_source_has(target, source):
    merge = Merge(["ID"], matched=[Update()], not_matched=[Insert()])
    assert rows(merge_rows(target, source, merge)) == rows_of(
        [(1, "a", 10.0), (2, "b", 20.0), (2, "bb", 20.0), (3, "c", 3.0), (None, "n", 0.0),
         (4, None, 40.0), (4, None, 41.0), (None, None, 9.0)]
    )


def test_rows_that_the_source_lacks(target, source):
    merge = Merge(
        ["id"],
        not_matched_by_source=[
            Update({"name": "concat(target.name, '!')"}, "target.id = 3"), Delete("target.id IS NULL")
        ],
    )
    assert rows(merge_rows(target, source, merge)) == rows_of(
        [(1, "a", 1.0), (2, "b", 2.0), (2, "bb", 2.5), (3, "c!", 3.0)]
    )


def test_two_source_rows_for_one_target_row(target, source):
    again = source.unionAll(source.where("id = 2"))
    merge = Merge(["id"], matched=[Update({"amount": "source.amount"})])
    with pytest.raises(Exception, match="several source rows meet one target row"):
        merge_rows(target, again, merge).collect()
    # No clause for them: nothing happens to the rows they meet, and none is doubled.
    merge = Merge(["id"], not_matched=[Insert()])
    assert merge_rows(target, again, merge).count() == 5 + 3


def test_conditions_that_are_null_do_not_hold(spark, target):
    source = spark.createDataFrame([(1, None), (7, None)], "id INT, gone BOOLEAN")
    merge = Merge(["id"], matched=[Delete("source.gone")], not_matched=[Insert(condition="source.gone")])
    assert rows(merge_rows(target, source, merge)) == rows(target)


def test_actions(target, source):
    merge = Merge(
        ["id"], matched=[Delete("source.gone"), Update()], not_matched=[Insert()],
        not_matched_by_source=[Delete("target.id = 3")],
    )
    counts = merged_rows(target, source, merge).groupBy("__action").count().collect()
    assert dict(map(tuple, counts)) == {"kept": 1, "updated": 1, "deleted": 3, "inserted": 3}


def test_refused_at_analysis(target, source):
    with pytest.raises(ValueError, match="key columns not in the source"):
        merge_rows(target, source, Merge(["name"]))
    with pytest.raises(ValueError, match="none given"):
        merge_rows(target, source, Merge([]))
    with pytest.raises(ValueError, match="not in the target: nothing"):
        merge_rows(target, source, Merge(["id"], matched=[Update({"nothing": "1"})]))
    with pytest.raises(AnalysisException):
        merge_rows(target, source, Merge(["id"], matched=[Update({"amount": "'text'"})]))
    with pytest.raises(ValueError, match="named twice"):
        merge_rows(target, source, Merge(["id"], not_matched=[Insert({"id": "1", "ID": "2"})]))


def test_empty_sides(target, source):
    merge = Merge(["id"], matched=[Update()], not_matched=[Insert()])
    assert rows(merge_rows(target, source.limit(0), merge)) == rows(target)
    assert merge_rows(target.limit(0), source, merge).count() == 5


def test_several_keys(spark):
    rng = random.Random(2)
    made = {(rng.randrange(9), rng.choice("xy")): i for i in range(12)}
    target = spark.createDataFrame([(*k, v) for k, v in made.items()], "a INT, b STRING, v INT")
    source = spark.createDataFrame([(i, "x", -1) for i in range(12)], "a INT, b STRING, v INT")
    got = merge_rows(target, source, Merge(["a", "b"], matched=[Update()], not_matched=[Insert()]))
    want = made | {(i, "x"): -1 for i in range(12)}
    assert rows(got) == rows_of([(*k, v) for k, v in want.items()])


def test_versions(spark, folder, target, source):
    root = f"{folder}/table"
    versions.create(spark, root, TARGET, ["name"])
    versions.append(spark, root, target)
    before = {f for f, _, _ in versions._entry(spark, root, None).folders}
    merge = Merge(["id"], matched=[Delete("source.gone"), Update({"amount": "0"})], not_matched=[Insert()])
    assert versions.merge(spark, root, source, merge) == versions.Commit(2, 6)
    assert rows(versions.read(spark, root)) == rows(merge_rows(target, source, merge))
    assert rows(versions.read(spark, root, 1)) == rows(target)
    after = {f for f, _, _ in versions._entry(spark, root, None).folders}
    assert {f.split("name=")[1] for f in before & after} == {"c", "n"}
    again = source.unionAll(source.where("id = 1"))
    with pytest.raises(Exception, match="several source rows"):
        versions.merge(spark, root, again, merge)
    assert versions.versions(spark, root) == [0, 1, 2]
    nothing = source.where("id = 99")
    assert versions.merge(spark, root, nothing, merge) == versions.Commit(2, 0)
    assert [r.operation for r in versions.history(spark, root).orderBy("version").collect()] == [
        "create", "append", "merge"
    ]


def test_keys_are_not_gathered_into_few_tasks(spark):
    """Small as they are when shuffled, the keys of both sides stay in all shuffle partitions."""
    session = isolated_session(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"})
    target = session.range(20000).selectExpr("2 * id AS id", "0D AS amount")
    source = session.range(20000).selectExpr("3 * id AS id", "1D AS amount")
    added = added_rows(target, source, Merge(["id"], not_matched=[Insert()]))
    per_task = added.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(per_task) == 8 and max(r.n for r in per_task) < 2 * (10000 + 3333) / 8
    ids = {r[0] for r in added.select("__row.id").collect()}
    assert ids == {i for i in range(0, 60000, 3) if i % 2 or i >= 40000}


def test_repeated_keys_are_counted_in_all_tasks(spark):
    """The count of the keys, as small as they are when shuffled, stays in all shuffle partitions."""
    source = spark.range(20000).selectExpr("IF(id % 200 = 7, NULL, id div 2) AS id", "1D AS amount")
    repeated = repeated_keys(source, ["id"])
    per_task = repeated.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(per_task) == 8 and max(r.n for r in per_task) < 2 * 9900 / 8
    assert {tuple(r) for r in repeated.collect()} == {(i, 2) for i in range(10000) if i % 100 != 3}
