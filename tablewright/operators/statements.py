"""One SQL statement: what kind it is, its rows, its errors."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tablewright.operators.export import describe, export_parquet
from tablewright.operators.render import grid

# Fixed values of the texts.
COMMAND_TEXT = "Command executed successfully"
EMPTY_STATEMENT_TEXT = "SQL query is required"
EXPORT_FAILED_TEXT = "Failed to write Parquet: {error}"


@dataclass(frozen=True)
class Failure:
    """Why a statement failed: the error class and its message, never empty."""

    condition: str
    message: str

    def __str__(self) -> str:
        return f"{self.condition}: {self.message}"

    @classmethod
    def of(cls, error: Exception) -> Failure:
        condition = error.getCondition() if isinstance(error, PySparkException) else None
        return cls(condition or type(error).__name__, str(error) or repr(error))


@dataclass(frozen=True)
class StatementResult:
    """``kind`` is ``rows``, ``command`` or ``error``; ``df`` is the lazy result of ``rows``."""

    sql: str
    kind: str
    df: DataFrame | None = None
    error: Failure | None = None

    @property
    def success(self) -> bool:
        return self.error is None


@dataclass(frozen=True)
class Outcome:
    """A finished statement as text."""

    success: bool
    result: str
    error: str | None = None


ERRORS = (PySparkException, Py4JError, ValueError)


def run(spark: SparkSession, sql: str) -> StatementResult:
    """Analyse one statement; commands take effect here, rows stay lazy."""
    if not sql or not sql.strip():
        failure = Failure("EMPTY_STATEMENT", EMPTY_STATEMENT_TEXT)
        return StatementResult(sql, "error", error=failure)
    try:
        df = spark.sql(sql)
        if len(df.schema) == 0:
            return StatementResult(sql, "command")
        return StatementResult(sql, "rows", df)
    except ERRORS as error:
        return StatementResult(sql, "error", error=Failure.of(error))


def execute(spark: SparkSession, sql: str, output_path: str | None = None) -> Outcome:
    """Run one statement to its end.

    Rows become a bounded preview, or all of them are written to ``output_path``; a command
    ignores the path. An error at run time is a failure like one at analysis.
    """
    result = run(spark, sql)
    if result.kind == "error":
        return Outcome(False, "", str(result.error))
    if result.kind == "command":
        return Outcome(True, COMMAND_TEXT)
    try:
        if output_path is None:
            return Outcome(True, grid(result.df))
        files = export_parquet(result.df, output_path)
        return Outcome(True, describe(output_path, files, result.df.schema))
    except ERRORS as error:
        failure = str(Failure.of(error))
        if output_path is not None:
            failure = EXPORT_FAILED_TEXT.format(error=failure)
        return Outcome(False, "", failure)
