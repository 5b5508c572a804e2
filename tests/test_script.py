import uuid

from tablewright.operators.script import run_script


def outcomes(df):
    return [(r.idx, r.kind, r.success, r.n_rows) for r in df.orderBy("idx").collect()]


def test_four_statements(spark, folder):
    name = f"t_{uuid.uuid4().hex}"
    done = run_script(
        spark,
        [
            f"CREATE TABLE {name} (id INT) USING parquet",
            f"INSERT INTO {name} VALUES (1), (2), (3)",
            f"SELECT id FROM {name}",
            f"DROP TABLE {name}",
        ],
        folder,
    )
    assert outcomes(done) == [
        (0, "command", True, None),
        (1, "command", True, None),
        (2, "rows", True, 3),
        (3, "command", True, None),
    ]
    path = done.where("idx = 2").first().path
    assert spark.read.parquet(path).count() == 3


def test_errors_stop_the_script_only_if_asked(spark, folder):
    script = ["SELECT 1 AS a", "SELECT 1 / (id - 1) AS x FROM range(3)", "SELEC", "SELECT 2 AS b"]
    assert [o[2] for o in outcomes(run_script(spark, script, folder))] == [True, False, False, True]
    stopped = run_script(spark, script, folder, stop_on_error=True)
    assert [o[2] for o in outcomes(stopped)] == [True, False]
    failed = stopped.where("idx = 1").first()
    assert failed.path is None and failed.error.startswith("DIVIDE_BY_ZERO")


def test_views_and_settings_stay_inside(spark, folder):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    done = run_script(
        spark,
        [
            "CREATE TEMPORARY VIEW only_here AS SELECT 1 AS a",
            "SET spark.sql.shuffle.partitions = 3",
            "SELECT * FROM only_here",
        ],
        folder,
        settings={"spark.sql.shuffle.partitions": "5"},
    )
    assert all(r.success for r in done.collect())
    assert not spark.catalog.tableExists("only_here")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
