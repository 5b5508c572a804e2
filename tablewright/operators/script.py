"""A list of statements in order, with the outcome of each as a table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from tablewright.operators.export import write_parquet
from tablewright.operators.statements import ERRORS, Failure, run
from tablewright.session import isolated_session

OUTCOMES = (
    "idx int, sql string, kind string, success boolean, n_rows bigint, path string, error string"
)


def run_script(
    spark: SparkSession,
    statements: Iterable[str],
    out_dir: str,
    stop_on_error: bool = False,
    settings: Mapping[str, str] | None = None,
) -> DataFrame:
    """Run ``statements`` one after the other in a session of their own.

    The rows of statement *i* are written, complete, to ``out_dir/statement=i``. The result has
    one row per statement that was run; it is a description of the script, not of the data.
    """
    session = isolated_session(spark, settings)
    outcomes = []
    for idx, sql in enumerate(statements):
        result = run(session, sql)
        n_rows = path = None
        error = result.error
        if result.kind == "rows":
            path = f"{out_dir.rstrip('/')}/statement={idx}"
            try:
                n_rows = write_parquet(result.df, path)
            except ERRORS as raised:
                path, error = None, Failure.of(raised)
        failed = error is not None
        outcomes.append((idx, sql, result.kind, not failed, n_rows, path, str(error) if failed else None))
        if failed and stop_on_error:
            break
    return spark.createDataFrame(outcomes, OUTCOMES)
