"""Numbered versions of a table kept as Parquet folders.

``root/data/_v=N-<attempt>[/p=…]`` holds the rows that one attempt at commit N wrote and is never
changed afterwards: every attempt has a folder of its own, so a second writer, or a job that is run
again, cannot touch what another one committed.
``root/log/version=N`` holds one row that names the folders version N consists of. A commit
becomes visible when Spark finishes that log folder with ``_SUCCESS``; a job that dies earlier
leaves files that no version names. Of two writers that make the same version one gets its log
folder; the other fails and changes nothing that a version names.

An append writes only the new rows. An update or delete first finds the folders that hold a
selected row, by a scan of the predicate's columns, and rewrites these folders alone; partition
the table by what the changes select on and a change costs its partitions, not the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tablewright.functions.names import quoted
from tablewright.operators.export import manifest, write_parquet
from tablewright.operators.merge import (
    ACTION,
    DELETED,
    KEPT,
    ROW,
    Merge,
    added_rows,
    changed_rows,
)
from tablewright.operators.mutate import (
    Expression,
    as_column,
    conform,
    delete_rows,
    update_rows,
)
from tablewright.sources import folders

WRITTEN_BY = "_v"
FILE = "__file"
LOG_SCHEMA = (
    "version int, operation string, schema string, partition_by array<string>, "
    "n_rows bigint, bytes bigint, n_affected bigint, "
    "folders array<struct<folder: string, n_rows: bigint, bytes: bigint>>"
)


@dataclass(frozen=True)
class Commit:
    version: int
    n_affected: int


@dataclass(frozen=True)
class _Entry:
    version: int
    schema: StructType
    partition_by: list[str]
    folders: list[tuple[str, int, int]]


def _data(root: str) -> str:
    return f"{root.rstrip('/')}/data"


def _log(root: str) -> str:
    return f"{root.rstrip('/')}/log"


def _begun(spark: SparkSession, root: str) -> list[int]:
    names = folders.subfolders(spark, _log(root))
    return sorted(int(name.split("=", 1)[1]) for name in names if name.startswith("version="))


def versions(spark: SparkSession, root: str) -> list[int]:
    """The complete versions, oldest first."""
    return [
        version
        for version in _begun(spark, root)
        if _complete(spark, root, version)
    ]


def _complete(spark: SparkSession, root: str, version: int) -> bool:
    return folders.exists(spark, f"{_log(root)}/version={version}/_SUCCESS")


def _newest(spark: SparkSession, root: str) -> int | None:
    """The newest complete version: one listing, and one look per version that a dead job began
    after it, however long the history is."""
    begun = reversed(_begun(spark, root))
    return next((version for version in begun if _complete(spark, root, version)), None)


def _next(spark: SparkSession, root: str) -> int:
    """The next number; one that a dead job began is not used again."""
    return _begun(spark, root)[-1] + 1


def _entry(spark: SparkSession, root: str, version: int | None) -> _Entry:
    newest = _newest(spark, root)
    if newest is None:
        raise ValueError(f"no versioned table at {root}")
    wanted = newest if version is None else version
    if wanted != newest and not _complete(spark, root, wanted):
        raise ValueError(f"version {wanted} of {root} does not exist, the newest is {newest}")
    row = spark.read.schema(LOG_SCHEMA).json(f"{_log(root)}/version={wanted}").first()
    return _Entry(
        wanted,
        StructType.fromDDL(row.schema),
        list(row.partition_by),
        [tuple(folder) for folder in row.folders],
    )


def _commit(
    spark: SparkSession,
    root: str,
    version: int,
    operation: str,
    schema: StructType,
    partition_by: Sequence[str],
    live: Sequence[tuple[str, int, int]],
    n_affected: int,
) -> Commit:
    entry = {
        "version": version,
        "operation": operation,
        "schema": schema.toDDL(),
        "partition_by": list(partition_by),
        "n_rows": sum(n_rows for _, n_rows, _ in live),
        "bytes": sum(size for _, _, size in live),
        "n_affected": n_affected,
        "folders": [
            {"folder": folder, "n_rows": n_rows, "bytes": size} for folder, n_rows, size in live
        ],
    }
    line = spark.range(1, numPartitions=1).select(F.lit(json.dumps(entry)).alias("value"))
    line.write.mode("errorifexists").text(f"{_log(root)}/version={version}")
    if not _complete(spark, root, version):
        raise RuntimeError("the commit left no _SUCCESS file; let Spark mark finished jobs")
    return Commit(version, n_affected)


def _folder(file: str = "file"):
    """The part of a data file's path that names its folder below ``data``."""
    return F.regexp_extract(file, f"/data/({WRITTEN_BY}=.*)/[^/]*$", 1).alias("folder")


def _write(
    spark: SparkSession,
    root: str,
    version: int,
    df: DataFrame,
    schema: StructType,
    partition_by: Sequence[str],
    rebalance: bool = True,
) -> list[tuple[str, int, int]]:
    """Write the rows of one commit; the folders made, with counts from the file footers."""
    path = f"{_data(root)}/{WRITTEN_BY}={version}-{uuid.uuid4().hex}"
    write_parquet(df, path, partition_by, "errorifexists", rebalance)
    made = (
        manifest(spark, path, schema)
        .groupBy(_folder())
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("bytes").alias("bytes"))
        .where("n_rows > 0")
    )
    return [(unquote(row.folder), row.n_rows, row.bytes) for row in made.collect()]


def _rows(
    spark: SparkSession,
    root: str,
    entry: _Entry,
    live: Sequence[tuple[str, int, int]],
    file_column: str | None = None,
) -> DataFrame:
    """The rows of ``live`` folders, partition columns included, and the file of each if asked for."""
    file = [] if file_column is None else [F.col("_metadata.file_path").alias(file_column)]
    if not live:
        none = [F.lit(None).cast("string").alias(file_column)] if file else []
        return spark.createDataFrame([], entry.schema).select("*", *none)
    paths = [f"{_data(root)}/{folder}" for folder, _, _ in live]
    rows = spark.read.schema(entry.schema).option("basePath", _data(root)).parquet(*paths)
    return rows.select(*map(quoted, entry.schema.names), *file)


def create(
    spark: SparkSession,
    root: str,
    schema: StructType | str,
    partition_by: Sequence[str] = (),
    if_not_exists: bool = False,
) -> Commit:
    """``CREATE TABLE``: version 0, without rows."""
    newest = _newest(spark, root)
    if newest is not None:
        if if_not_exists:
            return Commit(newest, 0)
        raise ValueError(f"there is a versioned table at {root}")
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if WRITTEN_BY in declared.names:
        raise ValueError(f"the column name {WRITTEN_BY} is reserved")
    missing = [name for name in partition_by if name not in declared.names]
    if missing:
        raise ValueError(f"partition columns not in the schema: {', '.join(missing)}")
    return _commit(spark, root, 0, "create", declared, partition_by, [], 0)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest version, or ``VERSION AS OF version``; later commits do not change it."""
    entry = _entry(spark, root, version)
    return _rows(spark, root, entry, entry.folders)


def append(spark: SparkSession, root: str, rows: DataFrame, by_position: bool = False) -> Commit:
    """``INSERT INTO``: writes the new rows and keeps every folder there is.

    ``by_position`` is the form ``INSERT INTO t VALUES (…)``, which names no columns. In a partition
    column an empty text is read back as NULL, as Spark does with every partitioned table.
    """
    entry = _entry(spark, root, None)
    new = _next(spark, root)
    rows = conform(rows, entry.schema, by_position)
    made = _write(spark, root, new, rows, entry.schema, entry.partition_by)
    n_rows = sum(n for _, n, _ in made)
    return _commit(
        spark, root, new, "append", entry.schema, entry.partition_by, entry.folders + made, n_rows
    )


def overwrite(spark: SparkSession, root: str, rows: DataFrame) -> Commit:
    """Replace all rows; also puts the folders of many small appends together."""
    entry = _entry(spark, root, None)
    new = _next(spark, root)
    made = _write(spark, root, new, conform(rows, entry.schema), entry.schema, entry.partition_by)
    n_rows = sum(n for _, n, _ in made)
    return _commit(spark, root, new, "overwrite", entry.schema, entry.partition_by, made, n_rows)


def _touched(
    spark: SparkSession, root: str, entry: _Entry, where: Expression
) -> dict[str, int]:
    """Folders that hold a row ``where`` selects, and how many."""
    if not entry.folders:
        return {}
    paths = [f"{_data(root)}/{folder}" for folder, _, _ in entry.folders]
    selected = spark.read.schema(entry.schema).option("basePath", _data(root)).parquet(*paths)
    per_file = (
        selected.where(as_column(where))
        .groupBy(F.col("_metadata.file_path").alias("file"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_folder = per_file.groupBy(_folder()).agg(F.sum("n").alias("n"))
    return {unquote(row.folder): row.n for row in per_folder.collect()}


def _rewrite(spark, root, operation, where, change, assigned=()) -> Commit:
    entry = _entry(spark, root, None)
    touched = _touched(spark, root, entry, where)
    if not touched:
        return Commit(entry.version, 0)
    replaced = [folder for folder in entry.folders if folder[0] in touched]
    kept = [folder for folder in entry.folders if folder[0] not in touched]
    new = _next(spark, root)
    changed = change(_rows(spark, root, entry, replaced))
    # Rows that stay in their partitions are written by the tasks that read them, without a shuffle.
    parts = {name.lower() for name in entry.partition_by}
    moved = any(name.lower() in parts for name in assigned)
    made = _write(spark, root, new, changed, entry.schema, entry.partition_by, rebalance=moved)
    return _commit(
        spark,
        root,
        new,
        operation,
        entry.schema,
        entry.partition_by,
        kept + made,
        sum(touched.values()),
    )


def update(
    spark: SparkSession,
    root: str,
    assignments: Mapping[str, Expression],
    where: Expression = "true",
) -> Commit:
    """``UPDATE … SET … WHERE``; ``where`` must give the same answer each time it is asked."""
    return _rewrite(
        spark,
        root,
        "update",
        where,
        lambda rows: update_rows(rows, assignments, where),
        assignments,
    )


def delete(spark: SparkSession, root: str, where: Expression = "true") -> Commit:
    """``DELETE FROM … WHERE``; ``where`` must give the same answer each time it is asked."""
    return _rewrite(spark, root, "delete", where, lambda rows: delete_rows(rows, where))


def merge(spark: SparkSession, root: str, source: DataFrame, changes: Merge) -> Commit:
    """``MERGE INTO … USING source``: folders with a row that changes are written again, and the new
    rows with them. ``source`` is read several times and must give the same rows each time.

    Two source rows that meet one target row are an error, and no version is made.
    """
    entry = _entry(spark, root, None)
    live = _rows(spark, root, entry, entry.folders, file_column=FILE)
    decided = changed_rows(live, source, changes).where(F.col(ACTION) != KEPT)
    counts = decided.groupBy(_folder(f"{ROW}.{FILE}"), ACTION).agg(F.count(F.lit(1)).alias("n"))
    found = [(unquote(row.folder), row[ACTION], row.n) for row in counts.collect()]
    touched = {folder for folder, _, _ in found}
    replaced = [folder for folder in entry.folders if folder[0] in touched]
    kept = [folder for folder in entry.folders if folder[0] not in touched]
    rows = _rows(spark, root, entry, replaced)
    new_rows = changed_rows(rows, source, changes).where(F.col(ACTION) != DELETED)
    if changes.not_matched:
        everything = _rows(spark, root, entry, entry.folders)
        new_rows = new_rows.unionAll(added_rows(everything, source, changes))
    new = _next(spark, root)
    columns = [F.col(ROW)[name].alias(name) for name in entry.schema.names]
    made = _write(spark, root, new, new_rows.select(*columns), entry.schema, entry.partition_by)
    deleted = sum(n for _, action, n in found if action == DELETED)
    stayed = sum(n for _, n, _ in replaced) - deleted
    n_inserted = sum(n for _, n, _ in made) - stayed
    if not touched and not n_inserted:
        return Commit(entry.version, 0)
    affected = sum(n for _, _, n in found) + n_inserted
    return _commit(
        spark, root, new, "merge", entry.schema, entry.partition_by, kept + made, affected
    )


def history(spark: SparkSession, root: str) -> DataFrame:
    """``version, operation, n_rows, bytes, n_affected`` of every complete version."""
    paths = [f"{_log(root)}/version={v}" for v in versions(spark, root)]
    if not paths:
        raise ValueError(f"no versioned table at {root}")
    entries = spark.read.schema(LOG_SCHEMA).json(paths)
    return entries.select("version", "operation", "n_rows", "bytes", "n_affected")


def drop(spark: SparkSession, root: str, if_exists: bool = False) -> None:
    """``DROP TABLE``: remove the log and the data of all versions."""
    if _newest(spark, root) is None:
        if if_exists:
            return
        raise ValueError(f"no versioned table at {root}")
    folders.remove(spark, _log(root))
    folders.remove(spark, _data(root))
