"""Periodic runs of words, by a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends and
that is at least ``least_length`` words and ``least_exponent`` times q long. The dictionary names
every factor (stretch) of 1, 2, 4, ... words, equal factors alike; a name of one length is made from
two names of half that length. At each length L the occurrences of a name that follow each other at
one distance d of at most 2 L, three or more of them, form an arithmetic progression and propose the
period d. Proposals are extended to both sides with the dictionary itself, from its longest factors
down, and stretches found more than once are kept once.

Why nothing is missed: a run of period q and exponent 4 holds, for the power of two L with
q <= L < 2 q, the factor at its start and its copies q and 2 q further on. No copy lies closer, or
the run would have a smaller period; for the same reason a proposed period is the smallest.

Texts stay where they are: a task puts the words of several texts into one array (names carry the
number of the text, so factors of different texts are never equal) and sorts the names of each
length once. A factor that stands once is not looked at again, so most texts end after a few lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.common import with_free_name
from tablewright.llm.words import split_words

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
GROUP_BYTES = 2 << 20  # of texts that a task looks at together
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbered(words: pa.Array) -> np.ndarray:
    """Equal words as equal numbers."""
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Factors:
    """``names[k][i]`` names the factor of 2**k words at i; one that stands once has a name below 0
    that no other has. The last length has no factor that stands twice."""

    names: list[np.ndarray]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` on equal those from ``b`` on."""
        a, b = a.copy(), b.copy()
        first = a.copy()
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            fits = np.maximum(a, b) < len(names)
            same = np.zeros(len(a), bool)
            same[fits] = names[a[fits]] == names[b[fits]]
            a += same << k
            b += same << k
        return a - first

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before ``a`` equal those before ``b``."""
        a, b = a.copy(), b.copy()
        first = a.copy()
        for k in range(len(self.names) - 1, -1, -1):
            names, step = self.names[k], 1 << k
            fits = (np.minimum(a, b) >= step) & (np.maximum(a, b) - step < len(names))
            same = np.zeros(len(a), bool)
            same[fits] = names[a[fits] - step] == names[b[fits] - step]
            a -= same << k
            b -= same << k
        return first - a


def basic_factors(words: np.ndarray) -> tuple[Factors, np.ndarray, np.ndarray]:
    """The dictionary over numbered words, and the progressions found on the way: where they begin
    and the period that they propose."""
    n = len(words)
    levels, starts, periods = [], [], []
    at, key, k = np.arange(n), words, 0
    while True:
        length = 1 << k
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        # Names of factors that stand twice or more, in the order of the sort.
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(at)))
        repeated = np.repeat(sizes > 1, sizes)
        names = -1 - np.arange(n - length + 1)
        names[at[repeated]] = np.repeat(np.arange(len(first)), sizes)[repeated]
        levels.append(names)
        if not repeated.any():
            break
        gap = np.zeros(n - length + 1, np.int64)  # to the next occurrence, 0 if there is none
        follows = ~new[1:]
        gap[at[:-1][follows]] = (at[1:] - at[:-1])[follows]
        i = np.flatnonzero((gap > 0) & (gap <= 2 * length))
        i = i[gap[i + gap[i]] == gap[i]]
        if len(i):
            # Neighbouring progressions of one distance belong to one stretch; the first stands for all.
            head = np.ones(len(i), bool)
            head[1:] = (np.diff(i) != 1) | (np.diff(gap[i]) != 0)
            starts.append(i[head])
            periods.append(gap[i[head]])
        # A factor of twice the length stands twice only if both of its halves do.
        if n - 2 * length + 1 <= 0:
            break
        alive = names >= 0
        at = np.flatnonzero(alive[: n - 2 * length + 1] & alive[length : n - length + 1])
        key = names[at] * n + names[at + length]
        k += 1
        if not len(at):
            levels.append(-1 - np.arange(n - 2 * length + 1))
            break
    empty = np.zeros(0, np.int64)
    return (
        Factors(levels),
        np.concatenate(starts) if starts else empty,
        np.concatenate(periods) if periods else empty,
    )


def find_runs(
    words: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT
) -> np.ndarray:
    """Rows ``start, length, period`` of all runs of numbered words, by start and then period."""
    if len(words) < least_length:
        return np.zeros((0, 3), np.int64)
    factors, at, period = basic_factors(words)
    if not len(at):
        return np.zeros((0, 3), np.int64)
    before = factors.common_before(at, at + period)
    after = factors.common(at, at + period)
    runs = np.stack([at - before, before + after + period, period], axis=1)
    runs = runs[(runs[:, 1] >= least_length) & (runs[:, 1] >= least_exponent * runs[:, 2])]
    return np.unique(runs[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def collapsed(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay when each run keeps its first period only."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def runs_of_texts(
    words: pa.Array, begins: np.ndarray, least_length: int, least_exponent: int
) -> tuple[list[np.ndarray], np.ndarray]:
    """The runs of each text, numbered within it, and which of all words stay."""
    sizes = np.diff(begins)
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    numbers = numbered(words)
    distinct = int(numbers.max(initial=0)) + 1
    runs = find_runs(text_of * distinct + numbers, least_length, least_exponent)
    kept = collapsed(len(words), runs)
    cuts = np.searchsorted(runs[:, 0], begins)
    each = [runs[a:b] - [start, 0, 0] for a, b, start in zip(cuts, cuts[1:], begins)]
    return each, kept


def periodic_runs(
    documents: DataFrame,
    text_column: str = "text",
    least_length: int = LEAST_LENGTH,
    least_exponent: int = LEAST_EXPONENT,
    repeat_from=None,
) -> DataFrame:
    """All columns of ``documents`` (save those called as the new ones) with ``n_words``, ``runs``
    (start, length and period in words, by start and then period) and ``collapsed_text``, the text
    whose runs keep their first period only, its words joined by one blank.

    ``least_exponent`` must be 4 or more: the dictionary proposes every period of such runs.
    ``repeat_from``, if given, maps (row number in a batch, words) to other words before runs are
    looked for; see :func:`damage`. Words are stretches without blanks and U+0009 to U+000D. NULL and
    empty texts, and texts without words, have no runs and an empty ``collapsed_text``. Repeated rows
    are answered each, ties between runs do not arise (all are returned), an empty table gives no
    rows. Rows do not move.
    """
    if least_exponent < 4:
        raise ValueError("the dictionary finds runs of exponent 4 or more")
    names = ("n_words", "runs", "collapsed_text")
    kept_columns = [c for c in documents.columns if c.lower() not in names]
    text = with_free_name(documents, "text_")
    read = documents.select(*kept_columns, F.col(text_column).alias(text))
    answers = [
        F.lit(0).cast("bigint").alias("n_words"),
        F.lit(None).cast("array<struct<start:bigint,length:bigint,period:bigint>>").alias("runs"),
        F.lit("").alias("collapsed_text"),
    ]
    schema = documents.select(*kept_columns, *answers).schema
    for column in schema:
        column.nullable = True
    if repeat_from is not None:
        change, column = repeat_from
        key_at = kept_columns.index(column)

    def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, begins = split_words(batch.column(len(kept_columns)))
        if repeat_from is not None:
            words = words.take(pa.array(change(batch.column(key_at), begins)))
        runs, kept = runs_of_texts(words, begins, least_length, least_exponent)
        stays = np.concatenate([[0], np.cumsum(kept)])[begins]
        lists = pa.LargeListArray.from_arrays(pa.array(stays), words.filter(pa.array(kept)))
        flat = np.concatenate([*runs, np.zeros((0, 3), np.int64)])
        fields = [pa.array(flat[:, i]) for i in range(3)]
        ends = np.cumsum([0] + [len(r) for r in runs])
        found = pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(RUN))
        )
        joined = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [*batch.columns[: len(kept_columns)], pa.array(np.diff(begins)), found, joined],
            [*kept_columns, *names],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(len(kept_columns))), 0)
            total = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
            group = total // GROUP_BYTES
            cuts = np.flatnonzero(np.diff(group, prepend=-1, append=np.iinfo(np.int64).max))
            for a, b in zip(cuts, cuts[1:]):
                yield answer(batch.slice(a, b - a))

    return read.mapInArrow(run, schema)


def damage(ids: pa.Array, begins: np.ndarray) -> np.ndarray:
    """Which word stands at each place after a tenth of the texts, chosen by the CRC-32 h of their
    id as text, is made periodic: with g = h // 10, words from a = g % n on repeat the first p of
    them, p = 1 + (n - a) // (3 + g % 8). Texts without an id or words stay."""
    places = np.arange(begins[-1])
    for row, doc_id in enumerate(ids.to_pylist()):
        first, n = int(begins[row]), int(begins[row + 1] - begins[row])
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        places[first + a : first + n] = first + a + np.arange(n - a) % p
    return places

