"""MERGE: one pass of changes from a source table into a target table, by key.

A clause names what happens to rows: of target rows that a source row meets, of source rows that meet
no target row, of target rows that no source row meets. In a clause columns are written ``target.c``
and ``source.c``. Of the clauses of one kind the first whose condition holds is taken; a row that no
clause takes stays as it is (a source row that no clause takes is not inserted).

Keys are compared for equality, so a NULL in a key meets nothing. Rows with such a key, however many,
are not shuffled for the join. The target is the left side of an outer join: a small source is
broadcast by size and the target then stays where it is, and a hot key of a large one is split. Which
source rows meet nothing, and which keys repeat, is asked of the keys alone, in as many tasks as the
session has shuffle partitions: what a task holds there is that share of the keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from tablewright.functions.names import quoted
from tablewright.operators.mutate import Expression, as_column, conform, holds, required, unknown_names

TARGET, SOURCE = "target", "source"
ACTION, MET, ROW = "__action", "__met", "__row"
KEPT, UPDATED, DELETED, INSERTED = "kept", "updated", "deleted", "inserted"
AMBIGUOUS = "several source rows meet one target row"


@dataclass(frozen=True)
class Update:
    """``UPDATE SET``; without assignments every column that the source has (``SET *``)."""

    assignments: Mapping[str, Expression] | None = None
    condition: Expression = "true"


@dataclass(frozen=True)
class Delete:
    condition: Expression = "true"


@dataclass(frozen=True)
class Insert:
    """``INSERT``; without values every column that the source has (``INSERT *``)."""

    values: Mapping[str, Expression] | None = None
    condition: Expression = "true"


@dataclass(frozen=True)
class Merge:
    """What a merge does to rows of each kind, and the key: names that both sides have."""

    on: Sequence[str]
    matched: Sequence[Update | Delete] = field(default_factory=tuple)
    not_matched: Sequence[Insert] = field(default_factory=tuple)
    not_matched_by_source: Sequence[Update | Delete] = field(default_factory=tuple)


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.alias(name)


def _of(side: str, column: str) -> Column:
    return F.col(f"{side}.{quoted(column)}")


def _any_null(side: str, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (_of(side, key).isNull() for key in keys))


def _values(
    given: Mapping[str, Expression] | None, source: DataFrame, schema: StructType, what: str
) -> dict[str, Expression]:
    """The new values by declared name."""
    if given is None:
        known = {name.lower(): name for name in source.columns}
        return {n: _of(SOURCE, known[n.lower()]) for n in schema.names if n.lower() in known}
    unknown = unknown_names(given, schema)
    if unknown:
        raise ValueError(f"columns not in the target: {', '.join(unknown)}")
    declared = {name.lower(): name for name in schema.names}
    if len({name.lower() for name in given}) < len(given):
        raise ValueError(f"a column is named twice in {what}")
    return {declared[name.lower()]: value for name, value in given.items()}


def _row(schema: StructType, values: Mapping[str, Expression], otherwise: Column | None) -> Column:
    """A row of the target: new values, stored in the types of the target, and else old ones."""

    def column(f: StructField) -> Column:
        if f.name in values:
            new = as_column(values[f.name]).cast(f.dataType)
        else:
            new = F.lit(None).cast(f.dataType) if otherwise is None else _of(TARGET, f.name)
        return (new if f.nullable else required(new, f.name)).alias(f.name)

    return F.struct(*map(column, schema.fields))


def _stored(rows: DataFrame, schema: StructType, clauses, source: DataFrame) -> None:
    """Refuse at analysis what cannot be stored in the target, as an insert does."""
    for clause in clauses:
        if isinstance(clause, Delete):
            continue
        given = clause.assignments if isinstance(clause, Update) else clause.values
        values = _values(given, source, schema, type(clause).__name__.lower())
        conform(rows.select(*(as_column(e).alias(n) for n, e in values.items())), schema)


def _chosen(clauses, when: Column, source: DataFrame, schema: StructType):
    """Action and new row of the first clause that holds, and the conditions so far."""
    action, row = F.lit(KEPT), F.struct(*(_of(TARGET, f.name).alias(f.name) for f in schema.fields))
    old = row
    for clause in reversed(clauses):
        takes = when & holds(clause.condition)
        if isinstance(clause, Delete):
            action, row = F.when(takes, DELETED).otherwise(action), F.when(takes, old).otherwise(row)
        else:
            values = _values(clause.assignments, source, schema, "update")
            action = F.when(takes, UPDATED).otherwise(action)
            row = F.when(takes, _row(schema, values, old)).otherwise(row)
    return action, row


def _same(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (_of(TARGET, k) == _of(SOURCE, k) for k in keys))


def _sides(target: DataFrame, source: DataFrame, merge: Merge) -> tuple[DataFrame, DataFrame, list]:
    """Both sides by their names, and the key."""
    for side, name in ((target, TARGET), (source, SOURCE)):
        missing = unknown_names(merge.on, side.schema)
        if missing or not merge.on:
            raise ValueError(f"key columns not in the {name}: {', '.join(missing) or 'none given'}")
    return _side(target, TARGET), _side(source, SOURCE), list(merge.on)


def _keys_of(side: str, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.where(~_any_null(side, keys)).select(*(_of(side, k).alias(k) for k in keys))


def _spread_keys_of(side: str, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys in all shuffle partitions. Alone they are so small when shuffled that Spark would put
    millions of them into one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _keys_of(side, df, keys).repartition(n, *map(quoted, keys))


def repeated_keys(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that several rows of ``source`` have, and how many rows."""
    spread = _spread_keys_of(SOURCE, _side(source, SOURCE), keys)
    counted = spread.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias(MET))
    return counted.where(F.col(MET) > 1)


def changed_rows(target: DataFrame, source: DataFrame, merge: Merge) -> DataFrame:
    """``__action`` (kept, updated, deleted) and ``__row`` of every row of ``target``.

    Two source rows that meet one target row are an error when the result is read, whatever their
    conditions, if there is a clause for matched rows. Values are stored in the types of the target;
    an unknown column, and a type that cannot be stored, are refused at analysis.
    """
    t, s, keys = _sides(target, source, merge)
    schema = target.schema
    marked = s.where(~_any_null(SOURCE, keys)).withColumn(MET, F.lit(True)).alias(SOURCE)
    meeting = t.join(marked, _same(keys), "left")
    _stored(meeting, schema, (*merge.matched, *merge.not_matched_by_source), source)
    if not merge.matched:
        # Nothing happens to rows that meet others, and they stay one each.
        distinct = _spread_keys_of(SOURCE, s, keys).distinct().withColumn(MET, F.lit(True)).alias(SOURCE)
        meeting = t.join(distinct, _same(keys), "left")
    met = _of(SOURCE, MET).isNotNull()
    matched_action, matched_row = _chosen(merge.matched, met, source, schema)
    other_action, other_row = _chosen(merge.not_matched_by_source, ~met, source, schema)
    row = F.when(met, matched_row).otherwise(other_row)
    if merge.matched:
        repeated = repeated_keys(source, keys).alias(SOURCE)
        several = t.join(repeated, _same(keys), "left_semi")
        n = several.select(F.count(F.lit(1))).scalar()
        row = F.when((n > 0) & met, F.raise_error(F.lit(AMBIGUOUS))).otherwise(row)
    return meeting.select(
        F.when(met, matched_action).otherwise(other_action).alias(ACTION), row.alias(ROW)
    )


def added_rows(target: DataFrame, source: DataFrame, merge: Merge) -> DataFrame:
    """``__action`` (inserted) and ``__row`` of the source rows that meet no row of ``target`` and
    that a clause takes."""
    t, s, keys = _sides(target, source, merge)
    schema = target.schema
    _stored(s, schema, merge.not_matched, source)
    wanted = _spread_keys_of(SOURCE, s, keys).distinct().alias(SOURCE)
    met_keys = _keys_of(TARGET, t.join(wanted, _same(keys), "left_semi"), keys).distinct()
    new = (
        s.where(~_any_null(SOURCE, keys))
        .join(met_keys.alias(TARGET), _same(keys), "left_anti")
        .unionAll(s.where(_any_null(SOURCE, keys)))
        .alias(SOURCE)
    )
    inserted, made = F.lit(False), F.lit(None)
    for clause in reversed(merge.not_matched):
        takes = holds(clause.condition)
        values = _values(clause.values, source, schema, "insert")
        made = F.when(takes, _row(schema, values, None)).otherwise(made)
        inserted = F.when(takes, F.lit(True)).otherwise(inserted)
    return new.where(inserted).select(F.lit(INSERTED).alias(ACTION), made.alias(ROW))


def merged_rows(target: DataFrame, source: DataFrame, merge: Merge) -> DataFrame:
    """Every row that the merge looks at, with what happens to it: :func:`changed_rows`, followed by
    :func:`added_rows`."""
    changed = changed_rows(target, source, merge)
    return changed.unionAll(added_rows(target, source, merge)) if merge.not_matched else changed


def merge_rows(target: DataFrame, source: DataFrame, merge: Merge) -> DataFrame:
    """``target`` after ``MERGE INTO target USING source ON <key>``, in its columns and types."""
    rows = merged_rows(target, source, merge).where(F.col(ACTION) != DELETED)
    return rows.select(*(F.col(ROW)[name].alias(name) for name in target.columns))
