"""Folders for data that Spark writes: the shared work folder and a few file system questions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Paths given out, by application.
_MADE: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tablewright-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing was written to yet."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clean_up(spark: SparkSession) -> int:
    """Remove what this application wrote under :func:`fresh_folder`, when no frame needs it any more;
    how many folders there were."""
    paths = _MADE.pop(spark.sparkContext.applicationId, [])
    return sum(remove(spark, path) for path in paths)


def _hadoop_path(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, file_system = _hadoop_path(spark, path)
    return file_system.exists(hadoop_path)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path`` (none when it does not exist)."""
    hadoop_path, file_system = _hadoop_path(spark, path)
    if not file_system.exists(hadoop_path):
        return []
    return [s.getPath().getName() for s in file_system.listStatus(hadoop_path) if s.isDirectory()]


def remove(spark: SparkSession, path: str) -> bool:
    hadoop_path, file_system = _hadoop_path(spark, path)
    return file_system.delete(hadoop_path, True)


def rename(spark: SparkSession, path: str, new: str) -> None:
    hadoop_path, file_system = _hadoop_path(spark, path)
    if not file_system.rename(hadoop_path, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"{path} cannot be renamed to {new}")


def sibling(path: str, label: str) -> str:
    """A path next to ``path`` that nothing was written to yet; listings pass over its name."""
    parent, _, name = path.rstrip("/").rpartition("/")
    return f"{parent}/.{name}-{label}-{uuid.uuid4().hex}"
