import glob
import os

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tablewright.operators import versions
from tests.conftest import rows

SCHEMA = "id INT, name STRING, age INT"
USERS = [(1, "Alice", 30), (2, "Bob", 25)]


@pytest.fixture
def root(folder):
    return f"{folder}/ta ble"


def users(spark, data=USERS, schema=SCHEMA):
    return spark.createDataFrame(data, schema)


def test_create_insert_update_delete(spark, root):
    assert versions.create(spark, root, SCHEMA).version == 0
    assert versions.append(spark, root, users(spark)) == versions.Commit(1, 2)
    assert versions.update(spark, root, {"age": "31"}, "name = 'Alice'") == versions.Commit(2, 1)
    assert versions.delete(spark, root, "age < 30") == versions.Commit(3, 1)
    assert rows(versions.read(spark, root, 0)) == []
    assert versions.read(spark, root, 0).columns == ["id", "name", "age"]
    assert rows(versions.read(spark, root, 1)) == USERS
    assert rows(versions.read(spark, root, 2)) == [(1, "Alice", 31), (2, "Bob", 25)]
    assert rows(versions.read(spark, root)) == [(1, "Alice", 31)]
    history = versions.history(spark, root).orderBy("version").drop("bytes")
    assert [tuple(r) for r in history.collect()] == [
        (0, "create", 0, 0),
        (1, "append", 2, 2),
        (2, "update", 2, 1),
        (3, "delete", 1, 1),
    ]


def test_a_version_is_stable(spark, root):
    versions.create(spark, root, SCHEMA)
    versions.append(spark, root, users(spark))
    first = versions.read(spark, root, 1)
    versions.overwrite(spark, root, users(spark, [(9, "Zoe", 1)]))
    assert rows(first) == USERS
    assert rows(versions.read(spark, root)) == [(9, "Zoe", 1)]


def test_an_append_writes_only_new_rows(spark, root):
    versions.create(spark, root, SCHEMA)
    versions.append(spark, root, users(spark))
    versions.append(spark, root, users(spark, [(3, "Cy", 4)]))
    assert spark.read.parquet(f"{root}/data/_v=2-*").count() == 1
    assert versions.read(spark, root).count() == 3


def test_a_change_rewrites_only_the_partitions_it_touches(spark, root):
    versions.create(spark, root, "id INT, p STRING", ["p"])
    data = [(i, "abc"[i % 3]) for i in range(30)]
    versions.append(spark, root, users(spark, data, "id INT, p STRING"))
    assert versions.update(spark, root, {"id": "id + 100"}, "p = 'b' AND id < 10").n_affected == 3
    assert [os.path.basename(path) for path in glob.glob(f"{root}/data/_v=2-*/p=*")] == ["p=b"]
    expected = [(i + 100 if p == "b" and i < 10 else i, p) for i, p in data]
    assert rows(versions.read(spark, root)) == sorted(expected, key=repr)
    assert versions.delete(spark, root, "p = 'c'").n_affected == 10
    assert rows(versions.read(spark, root)) == sorted((e for e in expected if e[1] != "c"), key=repr)
    assert not glob.glob(f"{root}/data/_v=3-*/p=c")


def test_a_partition_value_can_change(spark, root):
    versions.create(spark, root, "id INT, p STRING", ["p"])
    versions.append(spark, root, users(spark, [(1, "a"), (2, "b")], "id INT, p STRING"))
    versions.update(spark, root, {"p": "'b'"}, "id = 1")
    assert rows(versions.read(spark, root)) == [(1, "b"), (2, "b")]


AWKWARD = ["a b", "c:d", "e%f", "g/h", None, "é+ü", "x=y*{z}", "01", "1"]


def test_awkward_partition_values(spark, root):
    versions.create(spark, root, "id INT, p STRING", ["p"])
    data = [(i, p) for i, p in enumerate(AWKWARD)]
    versions.append(spark, root, users(spark, data, "id INT, p STRING"))
    assert rows(versions.read(spark, root)) == sorted(data, key=repr)
    versions.update(spark, root, {"id": "id + 10"}, "p <> 'c:d' OR p IS NULL")
    assert rows(versions.read(spark, root)) == sorted(
        ((i if p == "c:d" else i + 10, p) for i, p in data), key=repr
    )


def test_nothing_selected_is_no_commit(spark, root):
    versions.create(spark, root, SCHEMA)
    assert versions.delete(spark, root) == versions.Commit(0, 0)
    versions.append(spark, root, users(spark))
    assert versions.update(spark, root, {"age": "1"}, "id > 10") == versions.Commit(1, 0)
    assert versions.versions(spark, root) == [0, 1]


def test_all_rows_deleted(spark, root):
    versions.create(spark, root, SCHEMA)
    versions.append(spark, root, users(spark))
    versions.delete(spark, root)
    assert rows(versions.read(spark, root)) == []
    versions.append(spark, root, users(spark))
    assert rows(versions.read(spark, root)) == USERS


def test_a_commit_that_died_is_not_a_version(spark, root):
    versions.create(spark, root, SCHEMA)
    versions.append(spark, root, users(spark))
    os.makedirs(f"{root}/log/version=2/_temporary")
    spark.range(5).write.parquet(f"{root}/data/_v=2-dead")
    assert versions.versions(spark, root) == [0, 1]
    assert rows(versions.read(spark, root)) == USERS
    assert versions.append(spark, root, users(spark, [(3, "Cy", 4)])).version == 3
    assert versions.read(spark, root).count() == 3


def test_null_predicates_and_types(spark, root):
    versions.create(spark, root, "id INT, v DOUBLE")
    versions.append(spark, root, users(spark, [(1, 10.0), (2, None)], "id BIGINT, v DOUBLE"))
    versions.update(spark, root, {"v": "1"}, "v > 5")
    assert rows(versions.read(spark, root)) == [(1, 1.0), (2, None)]
    assert versions.read(spark, root).schema.simpleString() == "struct<id:int,v:double>"


def test_create_and_drop(spark, root):
    versions.create(spark, root, SCHEMA)
    with pytest.raises(ValueError, match="there is a versioned table"):
        versions.create(spark, root, SCHEMA)
    assert versions.create(spark, root, SCHEMA, if_not_exists=True).version == 0
    versions.drop(spark, root)
    with pytest.raises(ValueError, match="no versioned table"):
        versions.read(spark, root)
    versions.drop(spark, root, if_exists=True)
    versions.create(spark, root, SCHEMA)
    with pytest.raises(ValueError, match="version 7"):
        versions.read(spark, root, 7)


def test_predicates_reach_the_scan(spark, root):
    versions.create(spark, root, "id INT, p STRING, v DOUBLE", ["p"])
    versions.append(spark, root, spark.sql("SELECT CAST(id AS INT) id, 'a' p, 1D v FROM range(9)"))
    plan = versions.read(spark, root).where("p = 'a' AND v > 0").select("id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(v), GreaterThan(v,0.0)]" in text
    assert "ReadSchema: struct<id:int,v:double>" in text and "(p#" in text.split("PartitionFilters")[1]
    assert plan.agg(F.count("id")).first()[0] == 9


STEP = st.one_of(
    st.tuples(st.just("append"), st.lists(st.tuples(st.integers(0, 9), st.sampled_from("ab")), max_size=4)),
    st.tuples(st.just("update"), st.integers(0, 9)),
    st.tuples(st.just("delete"), st.integers(0, 9)),
)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(STEP, min_size=2, max_size=4))
def test_any_sequence_of_commits(spark, tmp_path_factory, steps):
    root = str(tmp_path_factory.mktemp("any"))
    versions.create(spark, root, "id INT, p STRING", ["p"])
    state, states = [], {0: []}
    for kind, what in steps:
        if kind == "append":
            commit = versions.append(spark, root, users(spark, what, "id INT, p STRING"))
            state = state + what
        elif kind == "update":
            commit = versions.update(spark, root, {"id": "id + 1", "p": "'b'"}, f"id > {what}")
            state = [(i + 1, "b") if i > what else (i, p) for i, p in state]
        else:
            commit = versions.delete(spark, root, f"id < {what}")
            state = [(i, p) for i, p in state if i >= what]
        states[commit.version] = state
    for version, expected in states.items():
        assert rows(versions.read(spark, root, version)) == sorted(expected, key=repr)


def test_of_two_writers_of_one_version_one_fails_and_harms_nothing(spark, root, monkeypatch):
    versions.create(spark, root, SCHEMA)
    monkeypatch.setattr(versions, "_next", lambda spark, root: 1)
    versions.append(spark, root, users(spark))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        versions.append(spark, root, users(spark, [(7, "Late", 1)]))
    assert rows(versions.read(spark, root, 1)) == USERS
    assert [r.n_rows for r in versions.history(spark, root).orderBy("version").collect()] == [0, 2]


def test_a_read_looks_at_few_files_however_long_the_history(spark, root, monkeypatch):
    versions.create(spark, root, SCHEMA)
    looks = []
    real = versions.folders.exists
    for number in range(1, 200):
        os.makedirs(f"{root}/log/version={number}")
    for number in range(1, 200, 2):
        open(f"{root}/log/version={number}/_SUCCESS", "w").close()
    monkeypatch.setattr(
        versions.folders, "exists", lambda spark, path: looks.append(path) or real(spark, path)
    )
    assert versions._newest(spark, root) == 199 and len(looks) == 1


def test_insert_by_position_and_names_in_any_case(spark, root):
    versions.create(spark, root, SCHEMA)
    versions.append(spark, root, spark.sql("SELECT * FROM VALUES (1, 'Alice', 30)"), by_position=True)
    versions.append(spark, root, spark.sql("SELECT 2 AS ID, 'Bob' AS Name, 25 AS age"))
    versions.update(spark, root, {"AGE": "age + 1"}, "Id = 2")
    assert rows(versions.read(spark, root)) == [(1, "Alice", 30), (2, "Bob", 26)]
    with pytest.raises(ValueError, match="2 columns"):
        versions.append(spark, root, spark.sql("SELECT 1, 2"), by_position=True)


def test_a_change_that_moves_no_row_needs_no_rebalance(spark, root, monkeypatch):
    versions.create(spark, root, "id INT, p STRING", ["p"])
    versions.append(spark, root, spark.sql("SELECT CAST(id AS INT) AS id, IF(id < 5, 'a', 'b') AS p FROM range(9)"))
    seen = []
    real = versions.write_parquet

    def watched(df, path, partition_by, mode, rebalance):
        seen.append((rebalance, "Exchange" in df._jdf.queryExecution().executedPlan().toString()))
        return real(df, path, partition_by, mode, rebalance)

    monkeypatch.setattr(versions, "write_parquet", watched)
    versions.update(spark, root, {"id": "id + 100"}, "id = 3")
    versions.delete(spark, root, "id = 4")
    versions.update(spark, root, {"p": "'c'"}, "id = 7")
    assert seen == [(False, False), (False, False), (True, False)]
    assert rows(versions.read(spark, root).where("p = 'c'")) == [(7, "c")]
