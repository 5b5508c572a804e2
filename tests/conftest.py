import pytest

from tablewright.session import build_session
from tablewright.sources.folders import clean_up


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        {
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
        },
        master="local[*]",
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    clean_up(session)
    session.stop()


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def rows(df):
    """The rows of a frame as sorted tuples."""
    return sorted((tuple(row) for row in df.collect()), key=repr)
