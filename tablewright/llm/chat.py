"""Chat formatting: a state machine over roles, and text segments with loss flags from a template.

A conversation is one training example and is put together in one row; turns of different
conversations never meet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

START, INVALID = "^", "!"


@dataclass(frozen=True)
class Template:
    """How a turn is written, which roles are learned, and which role may follow which.

    ``opening``, ``middle`` and ``closing`` stand around the role and the text of a turn. Texts may
    hold any of them: what a text brings of ``mark`` is escaped, so a mark is always a real one.
    """

    opening: str = "<|im_start|>"
    middle: str = "\n"
    closing: str = "<|im_end|>\n"
    mark: str = "<|"
    learned: tuple[str, ...] = ("assistant",)
    follows: tuple[tuple[str, str], ...] = (
        (START, "system"),
        (START, "user"),
        ("system", "user"),
        ("user", "assistant"),
        ("assistant", "user"),
    )
    last: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if len(self.mark) != 2 or "\\" in self.mark or "\n" in self.mark or "n" in self.mark:
            raise ValueError("a mark is two characters without backslash, n and line feed")
        if not (self.opening.startswith(self.mark) and self.closing.startswith(self.mark)):
            raise ValueError("opening and closing start with the mark")
        if self.middle != "\n":
            raise ValueError("role and text are parted by a line feed")


CHATML = Template()


def escape(text: Column, template: Template = CHATML) -> Column:
    """Double every backslash and put one inside every mark."""
    a, b = template.mark
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit(a + b), F.lit(a + "\\" + b))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column, template: Template = CHATML) -> Column:
    """As :func:`escape`, and a line feed becomes a backslash and an n."""
    return F.replace(escape(role, template), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    with_feeds = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescape(with_feeds)


def _next_state(state: Column, role: Column, template: Template) -> Column:
    allowed = F.lit(False)
    for before, after in template.follows:
        allowed = allowed | ((state == before) & (role == after))
    return F.when(allowed, role).otherwise(F.lit(INVALID))


def format_chats(
    turns: DataFrame,
    template: Template = CHATML,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """``_id, n_turns, valid, segments, formatted``, one row per conversation.

    ``segments`` is an array of ``(text, loss)``: the opening, the text and the closing of every
    turn; loss is set on the texts of learned roles. ``formatted`` is all of them in a row.
    ``valid`` says whether the state machine of the template accepts the roles in their order;
    conversations that it refuses are formatted all the same, for the caller to drop.

    NULL roles and texts are empty. Rows are ordered by turn (NULL first), ties by role and text,
    repeated rows are repeated turns. Rows without an id are one conversation without an id. An
    empty table has no conversations. Other columns are not read.
    """
    empty = F.lit("")
    rows = turns.select(
        F.col(id_column).alias("_id"),
        F.struct(
            F.col(turn_column).alias("turn"),
            F.coalesce(F.col(role_column), empty).alias("role"),
            F.coalesce(F.col(text_column), empty).alias("text"),
        ).alias("_turn"),
    )
    chats = rows.groupBy("_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def written(turn: Column) -> Column:
        role = escape_role(turn["role"], template)
        no = F.lit(False)
        return F.array(
            segment(F.concat(F.lit(template.opening), role, F.lit(template.middle)), no),
            segment(escape(turn["text"], template), turn["role"].isin(*template.learned)),
            segment(F.lit(template.closing), no),
        )

    state = F.aggregate(
        F.transform("_turns", lambda turn: turn["role"]),
        F.lit(START),
        lambda state, role: _next_state(state, role, template),
    )
    chats = chats.select(
        "_id",
        F.size("_turns").cast("bigint").alias("n_turns"),
        state.isin(*template.last).alias("valid"),
        F.flatten(F.transform("_turns", written)).alias("segments"),
    )
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return chats.withColumn("formatted", joined)


def read_turns(formatted: Column, template: Template = CHATML) -> Column:
    """The turns of a formatted conversation again, as an array of ``(role, text)``."""
    parts = F.split(formatted, "\\Q" + template.closing + "\\E", -1)
    turns = F.slice(parts, 1, F.size(parts) - 1)
    begin = len(template.opening) + 1

    def turn(part: Column) -> Column:
        gap = F.instr(part, template.middle)
        return F.struct(
            unescape_role(F.substring(part, F.lit(begin), gap - begin)).alias("role"),
            unescape(F.substring(part, gap + 1, F.length(part))).alias("text"),
        )

    return F.transform(turns, turn)


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    learned = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(learned, lambda s: unescape(s["text"])), "")
