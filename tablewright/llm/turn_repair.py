"""Repair of the order of roles in conversations, by generalised LR parsing with edits.

The roles of a conversation, by their first letters, must form ``(s?(ua)+)?``. An LR table holds that
grammar. The parser follows all edits of the rows at once: keep a row, delete it, give it another
role, insert an empty turn. Its stacks share their lower parts; stacks with equal tops have equal
stacks below in this grammar, so of these only the one of the least (cost, audit) is followed. The
audit is the string of the edits' initials. Among audits of one cost none is the beginning of
another (it would lack an edit that costs something), so the least stays the least whatever follows.

Conversations are not gathered by key. All rows are put in order by a range partitioning over
conversation, turn and row, and each task reads its stretch as a stream. A conversation that lies
inside a stretch is parsed at once. One that reaches a border of a stretch, or is longer than a
segment, gives a table for each segment: the least (cost, audit) from every top that may come in to
every top that may go out. The tables of a conversation are folded in order, the chosen tops go back
to the segments, and those are parsed once more. A conversation may so hold any share of all rows;
a task keeps one segment in memory. Only its audit, which is one value of the result, is whole in
one place, and its digest is made from a stream of pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import SPACE, SPACE_CLASS, stage

# The LR table of  C -> O P | nothing,  O -> s | nothing,  P -> u a | P u a.  State 2 is "O",
# state 5 "O P"; a reduction names how many states it takes off and the symbol it leaves.
SHIFT = {(0, "s"): 1, (2, "u"): 3, (3, "a"): 4, (5, "u"): 6, (6, "a"): 7}
REDUCE = {
    (0, "u"): (0, "O"), (1, "u"): (1, "O"),
    (4, "u"): (2, "P"), (4, None): (2, "P"),
    (7, "u"): (3, "P"), (7, None): (3, "P"),
}
GOTO = {(0, "O"): 2, (2, "P"): 5}
ACCEPT = {0, 5}

START = (0,)
#: Every stack that a row can meet; reductions wait for the next symbol.
STACKS = (START, (0, 1), (0, 2, 3), (0, 2, 3, 4), (0, 2, 5, 6), (0, 2, 5, 6, 7))
BY_TOP = {stack[-1]: stack for stack in STACKS}

DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
END_MARKS = ".!?"
SEGMENT_ROWS, SEGMENT_CHARS = 2048, 4 << 20

CLEAN, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3


@lru_cache(maxsize=None)
def advanced(stack: tuple[int, ...], symbol: str | None) -> tuple[int, ...] | None:
    """The stack after the reductions that ``symbol`` allows and its shift; None where it has no
    place. For the end, None, the reduced stack if it is accepted."""
    while (stack[-1], symbol) in REDUCE:
        count, left = REDUCE[stack[-1], symbol]
        stack = stack[: len(stack) - count]
        stack += (GOTO[stack[-1], left],)
    if symbol is None:
        return stack if stack[-1] in ACCEPT else None
    state = SHIFT.get((stack[-1], symbol))
    return None if state is None else (*stack, state)


class Heads(dict):
    """The tops of the graph of stacks, each with its least (cost, audit)."""

    def offer(self, stack: tuple[int, ...] | None, cost: int, audit: str) -> bool:
        if stack is None:
            return False
        known = self.get(stack[-1])
        if known is not None and known <= (cost, audit):
            return False
        self[stack[-1]] = (cost, audit)
        return True

    def with_inserts(self) -> Heads:
        """What can also be reached by empty turns in front of the next row."""
        todo = list(self)
        while todo:
            top = todo.pop()
            cost, audit = self[top]
            for symbol in ROLES:
                stack = advanced(BY_TOP[top], symbol)
                if self.offer(stack, cost + INSERT, audit + "I"):
                    todo.append(stack[-1])
        return self

    def after(self, initial: str, kind: int, copies: int) -> Heads:
        """The tops behind a row that stands ``copies`` times; copies of a row that is not blank are
        duplicates of it."""
        new = Heads()
        spare = "D" * (copies - 1)
        more = DELETE * (copies - 1)
        for top, (cost, audit) in self.items():
            stack = BY_TOP[top]
            new.offer(stack, cost + DELETE + more, f"{audit}D{spare}")
            if kind in (BLANK, DUPLICATE):
                continue
            cost += more + (UNFINISHED if kind == TRUNCATED else 0)
            new.offer(advanced(stack, initial), cost, f"{audit}K{spare}")
            for symbol in ROLES:
                new.offer(advanced(stack, symbol), cost + REROLE, f"{audit}R{spare}")
        return new


def parsed(rows: Iterable[dict], top: int) -> Heads:
    """The tops behind ``rows`` for a parser that begins with ``top``."""
    heads = Heads({top: (0, "")})
    for row in rows:
        heads = heads.with_inserts().after(row["role"][:1], row["kind"], row["copies"])
    return heads.with_inserts()


def ended(heads: dict[int, tuple[int, str]]) -> tuple[tuple[int, str], int]:
    """The least (cost, audit) of an accepted top, and that top."""
    return min((best, top) for top, best in heads.items() if advanced(BY_TOP[top], None))


def repaired(rows: Iterable[dict], audit: str, top: int) -> list[dict]:
    """The turns that the edits of an audit make of ``rows``; ``top`` is where the parser stood."""
    wanted = "a" if top in (3, 6) else "u"  # the role of the next turn that is not kept
    edits, turns = iter(audit), []

    def turn(role: str, text: str):
        nonlocal wanted
        turns.append({"role": role, "text": text})
        wanted = "a" if role[:1] == "u" else "u"

    def inserted() -> str:
        for edit in edits:
            if edit != "I":
                return edit
            turn(ROLES[wanted], "")
        return ""

    for row in rows:
        for _ in range(row["copies"]):
            edit = inserted()
            if edit == "K":
                turn(row["role"], row["text"])
            elif edit == "R":
                turn(ROLES[wanted], row["text"])
    inserted()
    return turns


@dataclass
class Counts:
    """What can be counted in a stretch of rows in order, and its ends."""

    n_rows: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    first_initial: str | None = None
    last_initial: str | None = None

    def add(self, other: Counts):
        """Put the counts of the rows that follow behind these."""
        for name in ("n_rows", "blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        if self.last_initial is not None and other.first_initial is not None:
            self.illegal += self.last_initial + other.first_initial not in LEGAL
        if self.last_turn is not None and self.last_turn == other.first_turn:
            self.turns -= 1
        if self.first_turn is None:
            self.first_turn = other.first_turn
        if self.first_initial is None:
            self.first_initial = other.first_initial
        if other.last_turn is not None:
            self.last_turn = other.last_turn
        if other.last_initial is not None:
            self.last_initial = other.last_initial

    @classmethod
    def of(cls, row: dict) -> Counts:
        n, turn, initial = row["copies"], row["turn"], row["role"][:1]
        kind = row["kind"]
        return cls(
            n,
            n if kind == BLANK else 0,
            n if kind == DUPLICATE else n - 1 if kind != BLANK else 0,
            int(kind == TRUNCATED),
            n - 1,
            int(turn is not None),
            turn,
            turn,
            initial,
            initial,
        )

    def gaps(self) -> int:
        if self.first_turn is None:
            return 0
        return self.last_turn - self.first_turn + 1 - self.turns

    def values(self) -> dict:
        return {name: getattr(self, name) for name in NUMBERS} | {"gaps": self.gaps()}


NUMBERS = ("n_rows", "blank", "duplicate", "truncated", "illegal")
ROW = [("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("kind", pa.int32()),
       ("copies", pa.int64())]
TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
RESULT = [(name, pa.int64()) for name in (*NUMBERS, "gaps", "cost")] + [("audit", pa.string())]
ENDS = [("turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
        ("first_initial", pa.string()), ("last_initial", pa.string())]
PLACE = [("_id", pa.int64()), ("part", pa.int32()), ("segment", pa.int64())]
PATH = pa.struct([("enters", pa.int32()), ("leaves", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
SEGMENT = pa.schema(
    [*PLACE, ("cut", pa.bool_()), *RESULT, *ENDS, ("turns_repaired", pa.list_(TURN)),
     ("paths", pa.list_(PATH)), ("rows", pa.list_(pa.struct(ROW)))]
)
CHOICE = pa.schema([*PLACE, ("enters", pa.int32()), ("leaves", pa.int32()), *RESULT])

SPARK_ROW = "struct<turn:bigint,role:string,text:string,kind:int,copies:bigint>"
SPARK_PLACE = "_id BIGINT, part INT, segment BIGINT"
SPARK_RESULT = ", ".join(f"{name} BIGINT" for name in (*NUMBERS, "gaps", "cost")) + ", audit STRING"
SPARK_SEGMENT = (
    f"{SPARK_PLACE}, cut BOOLEAN, {SPARK_RESULT}, turns BIGINT, first_turn BIGINT, "
    "last_turn BIGINT, first_initial STRING, last_initial STRING, "
    "turns_repaired ARRAY<struct<role:string,text:string>>, "
    f"paths ARRAY<struct<enters:int,leaves:int,cost:bigint,audit:string>>, rows ARRAY<{SPARK_ROW}>"
)
SPARK_CHOICE = f"{SPARK_PLACE}, enters INT, leaves INT, {SPARK_RESULT}"


def counted(rows: Iterable[dict]) -> Counts:
    total = Counts()
    for row in rows:
        total.add(Counts.of(row))
    return total


def segment_row(place: dict, rows: list[dict], cut: bool) -> dict:
    counts = counted(rows)
    made = place | {"cut": cut} | counts.values()
    if not cut:
        (cost, audit), _ = ended(parsed(rows, START[-1]))
        return made | {"cost": cost, "audit": audit, "turns_repaired": repaired(rows, audit, START[-1])}
    paths = [
        {"enters": top, "leaves": end, "cost": cost, "audit": audit}
        for top in BY_TOP
        for end, (cost, audit) in parsed(rows, top).items()
    ]
    ends = {name: getattr(counts, name) for name, _ in ENDS}
    return made | ends | {"paths": paths, "rows": rows}


def batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= 500:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def segments_of(stretch: Iterator[dict]) -> Iterator[dict]:
    """The rows of one stretch as segments. Whether the first and the last conversation go on in a
    neighbouring stretch is not known here, so these are cut."""
    place, rows, chars, first = None, [], 0, True
    for row in stretch:
        here = {"_id": row.pop("_id"), "part": row.pop("part")}
        if place is None or here["_id"] != place["_id"]:
            if place is not None:
                yield segment_row(place, rows, cut=first or place["segment"] > 0)
                first = False
            place, rows, chars = here | {"segment": 0}, [], 0
        elif len(rows) >= SEGMENT_ROWS or chars >= SEGMENT_CHARS:
            yield segment_row(place, rows, cut=True)
            place, rows, chars = here | {"segment": place["segment"] + 1}, [], 0
        rows.append(row)
        chars += len(row["text"])
    if place is not None:
        yield segment_row(place, rows, cut=True)


def read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def make_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batched(segments_of(read_rows(batches)), SEGMENT)


def choose(table: pa.Table) -> pa.Table:
    """Which way a conversation takes through its segments."""
    segments = table.sort_by([("part", "ascending"), ("segment", "ascending")]).to_pylist()
    heads, came = {START[-1]: (0, "")}, []
    counts = Counts()
    for s in segments:
        counts.add(Counts(**{n: s[n] for n in NUMBERS}, **{name: s[name] for name, _ in ENDS}))
        new: dict[int, tuple[int, str]] = {}
        source: dict[int, int] = {}
        for p in s["paths"]:
            if p["enters"] in heads:
                cost, audit = heads[p["enters"]]
                best = (cost + p["cost"], audit + p["audit"])
                if p["leaves"] not in new or best < new[p["leaves"]]:
                    new[p["leaves"]], source[p["leaves"]] = best, p["enters"]
        heads = new
        came.append(source)
    (cost, audit), top = ended(heads)
    made = []
    for s, source in zip(reversed(segments), reversed(came)):
        made.append({n: s[n] for n, _ in PLACE} | {"enters": source[top], "leaves": top})
        top = source[top]
    made[-1] |= counts.values() | {"cost": cost, "audit": audit}
    return pa.Table.from_pylist(made, CHOICE)


PIECE = pa.schema([*CHOICE, ("turns_repaired", pa.list_(TURN))])


def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns of each segment, on the way that was chosen."""

    def pieces() -> Iterator[dict]:
        for s in read_rows(batches):
            rows = s.pop("rows")
            _, audit = parsed(rows, s["enters"])[s["leaves"]]
            yield s | {"turns_repaired": repaired(rows, audit, s["enters"])}

    yield from batched(pieces(), PIECE)


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its pieces in order; only the digest is kept between pieces."""

    def rows() -> Iterator[dict]:
        row, sha, empty = None, None, True
        for s in read_rows(batches):
            turns = s.pop("turns_repaired")
            if row is None or s["_id"] != row["_id"]:
                if row is not None:
                    yield row | {"repaired_sha256": sha.hexdigest()}
                row, sha, empty = s, hashlib.sha256(), True
            for turn in turns:
                line = f"{turn['role']}:{turn['text']}"
                sha.update((line if empty else f"\n{line}").encode())
                empty = False
        if row is not None:
            yield row | {"repaired_sha256": sha.hexdigest()}

    schema = pa.schema([("_id", pa.int64()), *RESULT, ("repaired_sha256", pa.string())])
    yield from batched(rows(), schema)


@dataclass(frozen=True)
class Repair:
    """``summaries`` has a row per conversation, ``turns`` the repaired turns in order of ``part``,
    ``segment`` and ``at``."""

    summaries: DataFrame
    turns: DataFrame


def fault(text: Column) -> Column:
    """The first fault of a row that can be seen in its text."""
    ending = F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))
    return (
        F.when(~F.rlike(text, F.lit(f"[^{SPACE_CLASS}]")), BLANK)
        .when(~F.contains(F.lit(END_MARKS), ending), TRUNCATED)
        .otherwise(CLEAN)
    )


def repair(
    turns: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> Repair:
    """The cheapest repair of every conversation of ``turns``.

    ``summaries``: ``_id``, ``n_rows``, ``gaps`` (missing turn numbers), ``blank``, ``duplicate``
    (role and text seen earlier), ``truncated`` (no end mark), each row by its first fault,
    ``illegal`` (neighbours whose roles may not follow each other), ``cost``, ``audit`` and
    ``repaired_sha256`` of the repaired ``role:text``, one a line. ``turns``: the repaired turns.

    Rows go by turn (NULL first), then role, then the MD5 of the text. NULL in role or text counts as
    one blank; a role that is empty, or begins with another letter than s, u or a, cannot be kept but
    may get another. Rows that repeat one another are duplicates of the first. All rows without an id
    are one conversation. An empty table gives no rows. Other columns are not read.
    """
    rows = turns.select(
        F.col(id_column).cast("bigint").alias("_id"),
        F.col(turn_column).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_column), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_column), F.lit(" ")).alias("text"),
    )
    # Equal rows become one with a count, so that no number of copies meets in one place.
    distinct = (
        rows.groupBy("_id", "turn", "role", "text")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("_md5", F.md5("text"))
    )
    when = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    firsts = distinct.groupBy(
        F.col("_id").alias("_of"), F.col("role").alias("_role"), F.col("_md5").alias("_digest")
    ).agg(F.min(when).alias("_first"))
    same = (
        F.col("_id").eqNullSafe(F.col("_of"))
        & (F.col("role") == F.col("_role"))
        & (F.col("_md5") == F.col("_digest"))
    )
    kind = F.when((fault(F.col("text")) != BLANK) & (when > F.col("_first")), DUPLICATE)
    order = ["_id", "turn", "role", "_md5"]
    in_order = (
        distinct.join(firsts, same)
        .withColumn("kind", F.coalesce(kind, fault(F.col("text"))))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("_id", F.spark_partition_id().alias("part"), "turn", "role", "text", "kind", "copies")
    )
    segments = stage(in_order.mapInArrow(make_segments, SPARK_SEGMENT), "turn-segments")
    cut, whole = segments.where("cut"), segments.where("NOT cut")

    ends = [name for name, _ in ENDS]
    tables = cut.select("_id", "part", "segment", *NUMBERS, *ends, "paths")
    choices = tables.groupBy("_id").applyInArrow(choose, SPARK_CHOICE)
    place = ["_id", "part", "segment"]
    chosen = choices.withColumnsRenamed({c: f"_c_{c}" for c in place})
    at_place = F.lit(True)
    for c in place:
        at_place &= F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    results = [name for name, _ in RESULT]
    pieces = stage(
        cut.select(*place, "rows")
        .join(chosen, at_place)
        .select(*place, "enters", "leaves", *results, "rows")
        .mapInArrow(
            rewrite, f"{SPARK_CHOICE}, turns_repaired ARRAY<struct<role:string,text:string>>"
        ),
        "turn-pieces",
    )
    streamed = (
        pieces.repartition("_id")
        .sortWithinPartitions("_id", "part", "segment")
        .mapInArrow(digests, f"_id BIGINT, {SPARK_RESULT}, repaired_sha256 STRING")
    )
    lines = F.transform("turns_repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    inside = whole.select(
        "_id", *results, F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256")
    )
    made = whole.select(*place, "turns_repaired").unionAll(pieces.select(*place, "turns_repaired"))
    return Repair(
        inside.unionAll(streamed),
        made.select(*place, F.posexplode("turns_repaired").alias("at", "_turn")).select(
            *place, "at", "_turn.role", "_turn.text"
        ),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with rows damaged by the CRC-32 of
    ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes its end marks out, 3
    repeats it, 4 makes it the user's. NULL in any column stands for one blank there."""
    blank = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), blank),
        F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), blank),
    )
    fate = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return (
        conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fate.alias("_fate"))
        .where("_fate != 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_fate") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("_fate") == 1, "")
            .when(F.col("_fate") == 2, F.translate("text", END_MARKS, ""))
            .otherwise(F.col("text"))
            .alias("text"),
            F.explode(F.expr("sequence(1, if(_fate = 3, 2, 1))")).alias("_copy"),
        )
        .drop("_copy")
    )
