"""Quality rules: clean a text line by line first, then reject what lost too much.

Every step is an expression over one row, so nothing is shuffled and a text costs its own length.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import SPACE, SPACE_CLASS

SYMBOLS = "#*$%&|<>"
END_MARKS = ".!?…。！？:;\"'”’»)]।؟۔"
DOUBLED = ("!!", "??")
LONG_LINE = 80  # code points from which a line is a sentence and ends like one
LIST_ITEM = r"^[ \t]*([-*•·–]|[0-9]+[.)])[ \t]"
BARS = "»›•·"  # stand between the items of a menu, like |
ITEMS, ITEM_CHARS, ITEM_BLANKS = 3, 40, 3  # a menu has so many items or more, none of them longer
NAVIGATION = (
    r"(?i)^\W*(home|menu|next|previous|back|top|login|log in|sign in|sign up|subscribe|share|"
    r"read more|click here|contact us|about us|skip to content|search)\W*$"
)
BOILERPLATE = (
    "ll rights reserved",
    "ookie policy",
    "rivacy policy",
    "erms of use",
    "erms of service",
    "nable javascript",
    "nable JavaScript",
    "orem ipsum",
    "©",
    "opyright (c)",
    "opyright (C)",
)  # without the first letter where it may be a capital
MIN_WORDS = 50
MAX_LOSS = 0.5  # share of a text's characters in lines that fail
LINEAR_REPEATS = 64


def _words(text: Column) -> Column:
    padded = F.btrim(text, F.lit(SPACE))
    return F.when(padded == "", F.array().cast("array<string>")).otherwise(
        F.split(padded, f"[{SPACE_CLASS}]+", -1)
    )


def _neighbours(array: Column, join) -> Column:
    """``join(x[i], x[i + 1])`` for all i but the last."""
    n = F.greatest(F.size(array) - 1, F.lit(0))
    return F.zip_with(F.slice(array, 1, n), F.slice(array, 2, n), join)


def _covered(positions: Column) -> Column:
    """Words under windows of three that start at ascending positions."""
    steps = _neighbours(positions, lambda a, b: F.least(b - a, F.lit(3)))
    total = F.aggregate(steps, F.lit(3), lambda sum_, step: sum_ + step)
    return F.when(F.size(positions) == 0, F.lit(0)).otherwise(total)


def _without_symbols(text: Column) -> Column:
    for symbol in SYMBOLS:
        text = F.replace(text, F.lit(symbol), F.lit(""))
    return text


def is_menu(line: Column) -> Column:
    """Whether a line is a bar of three or more short items."""
    items = F.split(F.translate(line, BARS, "|" * len(BARS)), r" \| ", -1)

    def short(item: Column) -> Column:
        bare = F.trim(item)
        blanks = F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit("")))
        return (F.length(bare) <= ITEM_CHARS) & (blanks <= ITEM_BLANKS)

    bar = F.rlike(line, F.lit(f" [|{BARS}] "))
    return F.when(bar, (F.size(items) >= ITEMS) & F.forall(items, short)).otherwise(False)


def line_fails(line: Column) -> Column:
    """Whether a line with words is no text. Lines without words pass.

    Punctuation: more than a fifth of the line is marks, or a line as long as a sentence has no end
    mark and is no list item. Navigation: a bar of short items, or one listed phrase. Boilerplate: a
    listed phrase anywhere.
    """
    last = F.substring(F.rtrim(line), -1, 1)
    ends = F.contains(F.lit(END_MARKS), last)
    plain = _without_symbols(line)
    for pair in DOUBLED:
        plain = F.replace(plain, F.lit(pair), F.lit(""))
    noisy = (F.length(line) - F.length(plain)) * 5 > F.length(line)
    open_ended = (F.length(line) >= LONG_LINE) & ~ends & ~F.rlike(line, F.lit(LIST_ITEM))
    boilerplate = reduce(or_, (F.contains(line, F.lit(phrase)) for phrase in BOILERPLATE))
    return F.rlike(line, F.lit(r"\S")) & (
        open_ended | noisy | is_menu(line) | F.rlike(line, F.lit(NAVIGATION)) | boilerplate
    )


def quality(
    documents: DataFrame,
    min_words: int = MIN_WORDS,
    max_loss: float = MAX_LOSS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    clean_text, lost_chars, kept``, one row per row of ``documents``.

    ``n_repeat_words`` counts the words in windows of three that stand twice or more in the text.
    ``base_failed``: fewer than ``min_words`` words, or more than half of them repeated.
    ``clean_text`` holds the lines that pass :func:`line_fails`, in order; ``kept`` is false for a
    base failure and where failed lines hold more than ``max_loss`` of the characters in lines.

    NULL text has no words, so it fails; ``clean_text`` is then empty. Repeated rows are judged one
    by one, other columns are not read, and an empty table gives no rows. Windows are compared by a 64-bit hash of the 64-bit hashes of their words.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = documents.select(
        F.col(id_column).alias("_id"), text.alias("_text"), _words(text).alias("_words")
    )
    rows = rows.withColumn("_one", F.transform("_words", lambda w: F.xxhash64(w)))
    one, ordered = F.col("_one"), F.col("_sorted")
    windows = F.transform(
        F.slice(one, 1, F.greatest(F.size(one) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(one, i + 1), F.get(one, i + 2)),
    )
    rows = rows.withColumn("_windows", windows)
    rows = rows.withColumn("_sorted", F.sort_array("_windows"))
    again = F.filter(ordered, lambda w, i: (i > 0) & (w == F.get(ordered, i - 1)))
    rows = rows.withColumn("_again", F.array_distinct(again))
    # Where few windows repeat they are looked up one by one; else sorting finds them.
    looked_up = F.array_compact(
        F.transform(
            "_windows", lambda w, i: F.when(F.array_contains(F.col("_again"), w), i)
        )
    )
    order = F.sort_array(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    pairs = _neighbours(
        order, lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"]))
    )
    sorted_out = F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs))))
    places = (
        F.when(F.size("_again") == 0, F.array().cast("array<int>"))
        .when(F.size("_again") <= LINEAR_REPEATS, looked_up)
        .otherwise(sorted_out)
    )
    rows = rows.select(
        "_id",
        "_text",
        F.size("_words").alias("_n"),
        F.length(F.array_join("_words", "")).alias("_word_chars"),
        places.alias("_places"),
        F.split("_text", "\n", -1).alias("_all"),
    )
    lines = F.filter("_all", lambda line: F.rlike(line, F.lit(f"[^{SPACE_CLASS}]")))
    rows = rows.select(
        "*",
        lines.alias("_lines"),
        F.filter("_all", lambda line: ~line_fails(line)).alias("_kept_lines"),
    )
    n_words, repeated = F.col("_n").cast("bigint"), _covered(F.col("_places")).cast("bigint")
    n_chars = F.length("_text") - F.size("_all") + 1
    clean = F.array_join("_kept_lines", "\n")
    kept_chars = F.length(clean) - F.greatest(F.size("_kept_lines") - 1, F.lit(0))
    lost = n_chars - kept_chars
    base_failed = (n_words < min_words) | (F.lit(100) * repeated > F.lit(50) * n_words)
    return rows.select(
        "_id",
        n_words.alias("n_words"),
        F.col("_word_chars").cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(_without_symbols(F.col("_text"))))
        .cast("bigint")
        .alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines")))
        .cast("bigint")
        .alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        base_failed.alias("base_failed"),
        clean.alias("clean_text"),
        lost.cast("bigint").alias("lost_chars"),
        (~base_failed & (lost <= F.lit(max_loss) * n_chars)).alias("kept"),
    )
