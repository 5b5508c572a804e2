from hypothesis import HealthCheck, given, settings, strategies as st

from tablewright.operators.changes import as_of
from tests.conftest import rows

changes = st.lists(st.tuples(st.integers(0, 4), st.booleans()), max_size=12)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(changes, st.integers(0, 12))
def test_as_of_is_the_fold_of_the_log(spark, log, at):
    data = [(k, version, gone) for version, (k, gone) in enumerate(log)]
    df = spark.createDataFrame(data, "k INT, version INT, gone BOOLEAN")
    state = {}
    for k, version, gone in data:
        if version <= at:
            state[k] = (k, version, gone)
    expected = [row for row in state.values() if not row[2]]
    assert rows(as_of(df, ["k"], ["version"], f"version <= {at}", "gone")) == sorted(expected, key=repr)


def test_null_keys_and_null_tombstones(spark):
    df = spark.createDataFrame([(None, 1, None), (None, 2, None), (1, 1, True)], "k INT, v INT, gone BOOLEAN")
    assert rows(as_of(df, ["k"], ["v"], tombstone="gone")) == [(None, 2, None)]
