"""Whole results to Parquet, with a manifest of the files written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from tablewright.functions.names import quoted
from tablewright.sources.folders import exists, remove, rename, sibling

# Fixed values of the text that describes an export.
EXPORT_TEXT = """Results written to Parquet successfully!

Output Directory: {path}
Row Count: {n_rows}
Parquet Files: {n_files}

Files:
{names}

Schema:
{tree}
"""
NO_FILES_TEXT = "No Parquet files found (write may have failed)"

NAMES = 1000  # that the text lists at most; the manifest has all


def write_parquet(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
    rebalance: bool = True,
) -> int:
    """Write all of ``df`` and return the number of rows, counted while they are written.

    A partitioned write is preceded by a rebalance on the partition columns: a partition value is
    written by few tasks instead of by all, and AQE splits a value that holds much of the data
    over several. The count sits behind that shuffle, in the stage that writes, where a task that
    runs again after an executor loss is counted once.

    What stands at ``path`` is replaced when the write has succeeded, not before: the rows go to a
    folder next to it, which then takes its name. So a query may read from ``path``, in whatever
    way, and one that fails leaves it as it was. Between the two renames nothing stands at ``path``: a
    driver that is lost there leaves the old and the new rows under hidden names beside it. On an
    object store taking a name copies the data; write to a new path there.
    """
    spark = df.sparkSession
    if mode == "overwrite" and exists(spark, path):
        new = sibling(path, "new")
        try:
            n_rows = write_parquet(df, new, partition_by, "errorifexists", rebalance)
        except BaseException:
            remove(spark, new)
            raise
        old = sibling(path, "old")
        rename(spark, path, old)
        rename(spark, new, path)
        remove(spark, old)
        return n_rows
    if partition_by and rebalance:
        df = df.hint("rebalance", *(F.col(quoted(name)) for name in partition_by))
    written = Observation()
    (
        df.observe(written, F.count(F.lit(1)).alias("n_rows"))
        .write.mode(mode)
        .option("partitionOverwriteMode", "static")
        .partitionBy(*partition_by)
        .parquet(path)
    )
    return written.get["n_rows"]


def manifest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The Parquet files under ``path``: ``file, n_rows, bytes``.

    Row counts come from the file footers (the scan reads no column), sizes from the file
    listing, which also shows files without rows.
    """
    file = F.col("_metadata.file_path").alias("file")
    rows = spark.read.schema(schema).parquet(path).select(
        file, F.lit(1).cast("bigint").alias("n_rows"), F.lit(None).cast("bigint").alias("bytes")
    )
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select(file, F.lit(0).cast("bigint").alias("n_rows"), F.col("length").alias("bytes"))
    )
    return (
        rows.unionAll(files)
        .groupBy("file")
        .agg(F.sum("n_rows").alias("n_rows"), F.max("bytes").alias("bytes"))
    )


def export_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Replace ``path`` by the rows of ``df`` and return the manifest of what was written."""
    write_parquet(df, path, partition_by)
    return manifest(df.sparkSession, path, df.schema)


def summarize(files: DataFrame) -> DataFrame:
    """One row over a manifest: ``n_files, n_rows, bytes``."""
    return files.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
    )


def describe(path: str, files: DataFrame, schema: StructType) -> str:
    """The outcome of an export as text, with the names of its files in order.

    Beyond ``NAMES`` files the text says how many more there are; the manifest names them all.
    """
    total = summarize(files).first()
    names = [row.file for row in files.select("file").orderBy("file").limit(NAMES).collect()]
    if total.n_files > len(names):
        names.append(f"and {total.n_files - len(names)} more")
    return EXPORT_TEXT.format(
        path=path,
        n_rows=total.n_rows,
        n_files=total.n_files,
        names="\n".join(names) or NO_FILES_TEXT,
        tree=schema.treeString(),
    )
