"""Drop lines that many documents share.

Lines are exploded with their position, normalised and hashed; documents are counted per hash; a
hash over the threshold gives back the positions to drop, and the rest of the text is put together
by position. No text is shuffled with the lines: what is staged, counted and joined are numbers, and
the documents move once, to meet the positions that they lose.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import lower_ascii, stage, trimmed

MIN_DOCUMENTS = 10
MIN_CHARS = 1


def line_key(line: Column) -> Column:
    """A line without white space at its ends and with A to Z in lower case."""
    return lower_ascii(trimmed(line))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_shared_lines(
    documents: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    min_chars: int = MIN_CHARS,
    id_column: str = "doc_id",
    text_column: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """``_id, _text, n_lines, n_dropped, kept_text`` for every row of ``documents``, and ``_carry``,
    a struct of the columns named in ``carry``.

    A line goes, wherever it stands, when its key has at least ``min_chars`` code points and is
    found in at least ``min_documents`` documents. Documents are told apart by their id: rows that
    repeat an id count once, and so do all rows without an id.

    NULL or empty text is one empty line, which has no key and stays (``kept_text`` is then empty).
    A text that loses every line is left as empty text. Other columns are not read.
    """
    carried = [F.struct(*carry).alias("_carry")] if carry else []
    rows = documents.select(
        F.col(id_column).alias("_id"),
        F.col(text_column).alias("_text"),
        # Rows that share the id and this number share their text, so they share its positions.
        F.xxhash64(text_column).alias("_same"),
        *carried,
    )
    kept_columns = ["_carry"] if carry else []
    keyed = rows.select(
        "_id", "_same", F.posexplode(_lines(F.col("_text"))).alias("_pos", "_line")
    ).select("_id", "_same", "_pos", line_key(F.col("_line")).alias("_key"))
    # Staged, as making the keys is most of the work and two branches need the hashes. Two hash
    # functions, 96 bits together.
    lines = stage(
        keyed.select(
            "_id",
            "_same",
            "_pos",
            F.xxhash64("_key").alias("_h"),
            F.hash("_key").alias("_g"),
            F.length("_key").alias("_chars"),
        ),
        "lines",
    ).where(F.col("_chars") >= min_chars)
    # Staged, so that the join to it is between two exchanges, of which a hot line's can be split.
    shared = stage(
        lines.groupBy("_h", "_g")
        .agg(F.count_distinct(F.struct("_id")).alias("_documents"))
        .where(F.col("_documents") >= min_documents)
        .select("_h", "_g"),
        "shared-lines",
    )
    dropped = (
        lines.join(shared, ["_h", "_g"])
        .groupBy("_id", "_same")
        .agg(F.array_sort(F.collect_set("_pos")).alias("_drop"))
        .withColumnsRenamed({"_id": "_drop_id", "_same": "_drop_same"})
    )
    joined = rows.join(
        dropped,
        F.col("_id").eqNullSafe(F.col("_drop_id")) & (F.col("_same") == F.col("_drop_same")),
        "left",
    ).select(
        "_id",
        "_text",
        _lines(F.col("_text")).alias("_all"),
        F.coalesce("_drop", F.array().cast("array<int>")).alias("_drop"),
        *kept_columns,
    )
    # The stretches between two dropped positions, one slice each: linear in the lines.
    ends = F.concat(F.col("_drop"), F.array(F.size("_all")))
    starts = F.concat(F.array(F.lit(-1)), F.col("_drop"))
    gaps = joined.withColumn("_gaps", F.arrays_zip(starts.alias("a"), ends.alias("b")))
    kept = F.flatten(
        F.transform("_gaps", lambda g: F.slice(F.col("_all"), g["a"] + 2, g["b"] - g["a"] - 1))
    )
    return gaps.select(
        "_id",
        "_text",
        F.size("_all").cast("bigint").alias("n_lines"),
        F.size("_drop").cast("bigint").alias("n_dropped"),
        F.when(F.size("_drop") == 0, F.coalesce("_text", F.lit("")))
        .otherwise(F.array_join(kept, "\n"))
        .alias("kept_text"),
        *kept_columns,
    )
