import pytest

from tablewright.session import build_session, isolated_session, parse_settings
from tablewright.sources import folders


def test_parse_settings():
    assert parse_settings(["a.b=1", "c=x=y", "nothing", "d="]) == {"a.b": "1", "c": "x=y", "d": ""}


def test_settings_reach_the_session(spark):
    assert build_session("tests", {"spark.sql.shuffle.partitions": "8"}) is not None
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_an_isolated_session_inherits_settings_and_keeps_its_own(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        child = isolated_session(spark, {"spark.sql.ansi.enabled": "false"})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert child.conf.get("spark.sql.shuffle.partitions") == "11"
    assert child.conf.get("spark.sql.ansi.enabled") == "false"
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_shared_folder_is_the_one_the_cluster_names(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = folders.shared_folder(spark)
    assert folder == (named or spark.sparkContext.getCheckpointDir()).rstrip("/")
    assert folders.fresh_folder(spark, "x") != folders.fresh_folder(spark, "x")


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        folders.shared_folder(Session())


def test_catalogs_set_at_run_time_reach_the_child(spark):
    name = "spark.sql.catalog.other"
    spark.conf.set(name, "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")
    spark.conf.set(f"{name}.password", "hidden")
    try:
        child = isolated_session(spark)
        assert child.conf.get(name) == spark.conf.get(name)
        assert child.conf.get(f"{name}.password") == "hidden"
    finally:
        spark.conf.unset(name)
        spark.conf.unset(f"{name}.password")
