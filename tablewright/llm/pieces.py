"""SentencePiece encoding and decoding over a relational lattice.

The distinct words of a group of texts are exploded into all substrings up to the length of the
longest piece, joined to the table of pieces, and the edges found are grouped by word. A fold over
the edges of a word then picks its pieces.

Two folds are named here. For models of the unigram kind, :func:`viterbi_words` takes the path of
the highest sum of scores. The one public model at hand is of the BPE kind, whose encoder does not
look for that path (Viterbi gives other pieces for most words) but merges neighbours, best score
first; its fold makes, step by step, the best merge that a word has. Both are written with Spark's
joins and higher-order ``aggregate`` over a frame of words (:func:`viterbi_words`,
:func:`encoded_words`).

:func:`encode`, for whole texts, does the same steps in arrays inside a task: substrings are hashes
of all starts and one length at a time, the join is a lookup in the table of hashes, the fold makes
one merge of every word in each step. Words need not leave their texts, so nothing is shuffled and a
task holds one group of texts. The Spark form over all words of a corpus cannot meet the limits that
the README gives.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MARK = "▁"  # stands for a blank
MAX_CHARS = 60  # of a word whose boundaries are bits of a number; longer ones are merged by a queue
GROUP_BYTES = 2 << 20  # of texts that a task looks at together
PATH_CHARS = 1 << 15  # of words whose best paths are looked for together
UNKNOWN_PENALTY = 10.0  # below the worst score, as the library has it


@dataclass(frozen=True)
class Pieces:
    """The pieces of a model: ``table`` has (text, score, id) of all normal ones."""

    table: tuple[tuple[str, float, int], ...]
    byte_ids: tuple[int, ...]
    unknown: int

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Read a model file (BPE with byte fallback, blanks as marks, nothing else normalised)."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = [
            i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        ]
        octets = {model.id_to_piece(i): i for i in ids if model.is_byte(i)}
        rest = set(ids) - set(special) - set(octets.values())
        table = tuple((model.id_to_piece(i), model.get_score(i), i) for i in sorted(rest))
        if any(MARK in text.lstrip(MARK) or "\n" in text for text, _, _ in table):
            raise ValueError("a piece reaches over the end of a word")
        return cls(table, tuple(octets[f"<0x{i:02X}>"] for i in range(256)), model.unk_id())

    def rows(self) -> list[tuple[str, int, int, int, bool]]:
        """(text, length, rank, id, better): rank 0 has the best score, equal scores are equal;
        ``better`` says that a piece of at least this score has this one at an end, and at the other
        end a character or a piece that is made earlier, and so can stand there already."""
        ranks = {s: r for r, s in enumerate(sorted({-s for _, s, _ in self.table}))}
        known = {text: ranks[-score] for text, score, _ in self.table}
        better = set()
        for text, rank in known.items():
            for cut in range(1, len(text)):
                a, b = text[:cut], text[cut:]
                if a in known and b in known:
                    for x, y in ((a, b), (b, a)):
                        earlier = len(y) == 1 or known[y] <= known[x]
                        if len(x) > 1 and known[x] >= rank and earlier:
                            better.add(x)
        return [(text, len(text), known[text], i, text in better) for text, _, i in self.table]


class Merger:
    """Encoding of single words by a queue of merges, as the library does it; and decoding."""

    def __init__(self, pieces: Pieces):
        self.known = {text: (score, i) for text, score, i in pieces.table}
        self.byte_ids = pieces.byte_ids
        self.text = {i: text.encode() for text, _, i in pieces.table}
        self.octet = {i: bytes([o]) for o, i in enumerate(pieces.byte_ids)}

    def encode(self, word: str) -> list[int]:
        at = list(word)
        after, before = list(range(1, len(at) + 1)), list(range(-1, len(at) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int, j: int):
            joined = at[i] + at[j]
            if joined in self.known:
                heapq.heappush(queue, (-self.known[joined][0], i, joined))

        for i in range(len(at) - 1):
            offer(i, i + 1)
        while queue:
            _, i, joined = heapq.heappop(queue)
            j = after[i]
            if not at[i] or j >= len(at) or at[i] + at[j] != joined:
                continue
            at[i], at[j], after[i] = joined, "", after[j]
            if after[i] < len(at):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        ids: list[int] = []
        for text in filter(None, at):
            ids += self.char(text)
        return ids

    def char(self, text: str) -> list[int]:
        """The id of a piece, or those of the bytes of a character that is none."""
        known = self.known.get(text)
        return [known[1]] if known else [self.byte_ids[o] for o in text.encode()]

    def decode(self, ids: list[int]) -> str:
        """The text of pieces; the blank that encoding puts in front is taken away."""
        made = b"".join(self.text.get(i) or self.octet.get(i, b"") for i in ids)
        text = made.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


#: An edge is one number: rank, start, length, id, and whether a better piece may have it at an end.
#: In the order of these numbers the encoder would merge them.
RANK, START, LENGTH, ID = 33, 27, 21, 1
SMALL, LARGE = (1 << 6) - 1, (1 << 20) - 1


def lattice(words: DataFrame, table: DataFrame, longest: int, keys: list[str]) -> DataFrame:
    """``keys, _word, _edges``: the pieces of two characters or more that each word holds, from the
    best score down: ``packed``, a number (see ``RANK``), with ``own``, the boundaries of its
    characters but the last, and ``ends``, the first and the last, as bits.

    ``words`` has one row for every ``keys`` and ``_word``. Words without such a piece, and those of
    more than ``MAX_CHARS`` characters, have no row.
    """
    spans = (
        words.withColumn("_n", F.char_length("_word"))
        .where((F.col("_n") > 1) & (F.col("_n") <= MAX_CHARS))
        .select("*", F.explode(F.expr("sequence(1, _n - 1)")).alias("_start"))
        .select("*", F.explode(F.expr(f"sequence(2, least({longest}, _n - _start + 1))")).alias("_chars"))
        .select(*keys, "_word", "_start", F.expr("substring(_word, _start, _chars)").alias("_piece"))
    )
    # Made here, where Spark compiles expressions, and not in the lambdas of the fold.
    edge = F.struct(
        (F.col("_packed") + F.shiftleft((F.col("_start") - 1).cast("bigint"), START)).alias("packed"),
        F.expr("shiftleft(_own, _start - 1)").alias("own"),
        F.expr("shiftleft(_ends, _start - 1)").alias("ends"),
    )
    return (
        spans.join(table, "_piece")
        .groupBy(*keys, "_word")
        .agg(F.sort_array(F.collect_list(edge)).alias("_edges"))
    )


def inner_boundaries(state: Column, e: Column, n: int) -> Column:
    """Whether an edge begins and ends at boundaries of ``state``, which has a bit for each boundary
    between pieces, and has ``n`` - 1 of them inside."""
    inside = F.bit_count(state.bitwiseAND(e["own"])) == n
    return inside & (state.bitwiseAND(e["ends"]) == e["ends"])


def encoded_words(words: DataFrame, table: DataFrame, longest: int, keys: list[str]) -> DataFrame:
    """``keys, _word, _pieces``: the pieces of two characters or more in the encoding of a word, as
    numbers for :func:`word_ids`; NULL where a merge made a better one possible, which is left to
    :class:`Merger`, as are words without a row.
    """
    found = lattice(words, table, longest, keys)
    edges = F.col("_edges")

    def step(state: Column, e: Column) -> Column:
        # Of the boundaries that are its own, the first, which is among its ends, stays.
        merged = state.bitwiseXOR(state.bitwiseAND(e["own"])).bitwiseOR(e["ends"])
        # Earlier edges in the order have the better score. The last bit says that there are such.
        overtaken = (e["packed"].bitwiseAND(F.lit(1)) == 1) & F.exists(
            edges,
            lambda other: inner_boundaries(merged, other, 2) & (other["packed"] < e["packed"]),
        )
        return (
            F.when((state < 0) | ~inner_boundaries(state, e, 2), state)
            .when(overtaken, F.lit(-1).cast("bigint"))
            .otherwise(merged)
        )

    start = F.expr("shiftleft(1L, char_length(_word) + 1) - 1")
    folded = found.withColumn("_state", F.aggregate("_edges", start, step))
    state = F.col("_state")
    chosen = F.filter("_edges", lambda e: inner_boundaries(state, e, 1))
    # Start, length and id, so that they come in the order of the text.
    placed = F.transform(
        chosen, lambda e: F.shiftright(e["packed"], ID).bitwiseAND(F.lit((1 << (RANK - ID)) - 1))
    )
    return folded.select(
        *keys, "_word", F.when(state >= 0, F.sort_array(placed)).alias("_pieces")
    )


def piece_table(spark: SparkSession, pieces: Pieces) -> tuple[DataFrame, int]:
    """The pieces as rows to join with, and the length of the longest. A model has some ten
    thousand pieces; beyond a million they are not broadcast."""
    rows = [row for row in pieces.rows() if row[1] > 1]
    if max(row[3] for row in rows) > LARGE or max(row[2] for row in rows) > LARGE:
        raise ValueError("too many pieces for the numbers of edges")
    packed = [(r[2] << RANK) + (r[1] << LENGTH) + (r[3] << ID) + int(r[4]) for r in rows]
    table = spark.createDataFrame(
        pa.table(
            {
                "_piece": [r[0] for r in rows],
                "_packed": pa.array(packed, pa.int64()),
                "_own": pa.array([(1 << r[1]) - 1 for r in rows], pa.int64()),
                "_ends": pa.array([(1 << r[1]) + 1 for r in rows], pa.int64()),
            }
        )
    )
    small = len(rows) <= 1_000_000
    return (F.broadcast(table) if small else table), max(r[1] for r in rows)


def viterbi_words(words: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _word, ids, score``: the pieces of the highest sum of scores for every ``keys`` and
    ``_word``, by a table ``_piece, _score, _id`` of the unigram kind.

    Edges go through the fold by their end, so what leads to their start is known: per boundary the
    best sum and the pieces up to it. Of equal sums the one whose last piece begins first stays. Words
    that no path of pieces spells have NULL ids. Words are exploded and joined by substring, grouped by
    word; a word is one row, so a word is all that a task holds.
    """
    longest = table.agg(F.max(F.char_length("_piece"))).scalar()
    spans = (
        words.withColumn("_n", F.char_length("_word"))
        .select("*", F.explode(F.expr("if(_n > 0, sequence(0, _n - 1), array())")).alias("_start"))
        .withColumn("_longest", longest)
        .select(
            "*",
            F.explode(F.expr("sequence(1, least(_longest, _n - _start))")).alias("_chars"),
        )
        .withColumn("_piece", F.expr("substring(_word, _start + 1, _chars)"))
    )
    edge = F.struct(
        (F.col("_start") + F.col("_chars")).alias("end"),
        F.col("_start").alias("start"),
        F.col("_id").alias("id"),
        F.col("_score").alias("score"),
    )
    found = (
        spans.join(table, "_piece")
        .groupBy(*keys, "_word")
        .agg(F.sort_array(F.collect_list(edge)).alias("_edges"))
    )
    reached = "named_struct('score', {0}, 'ids', {1})"
    start = F.expr(
        "transform(sequence(0, char_length(_word)), i -> if(i = 0, "
        + reached.format("0D", "cast(array() as array<int>)")
        + ", cast(NULL as struct<score: double, ids: array<int>>)))"
    )

    def step(state: Column, e: Column) -> Column:
        before, now = F.get(state, e["start"]), F.get(state, e["end"])
        total = before["score"] + e["score"]
        better = before.isNotNull() & (now.isNull() | (total > now["score"]))
        new = F.struct(
            total.alias("score"), F.concat(before["ids"], F.array(e["id"].cast("int"))).alias("ids")
        )
        replaced = F.transform(state, lambda old, i: F.when(i == e["end"], new).otherwise(old))
        return F.when(better, replaced).otherwise(state)

    last = F.element_at(F.aggregate("_edges", start, step), -1)
    folded = found.select(*keys, "_word", last.alias("_last"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in (*keys, "_word")]
    renamed = folded.withColumnsRenamed({k: f"_of_{k}" for k in (*keys, "_word")})
    empty = F.col("_word") == ""
    return words.join(renamed, same, "left").select(
        *keys,
        "_word",
        F.when(empty, F.array().cast("array<int>")).otherwise(F.col("_last.ids")).alias("ids"),
        F.when(empty, 0.0).otherwise(F.col("_last.score")).alias("score"),
    )


def scrambled(numbers: np.ndarray, salt: int) -> np.ndarray:
    """Numbers spread over 64 bits (the finisher of SplitMix64)."""
    x = numbers.astype(np.uint64) + np.uint64(salt)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
SALTS = (1, 0x5851F42D4C957F2D)


def powers(base: int, n: int) -> np.ndarray:
    made = np.full(n, base, np.uint64)
    made[:1] = 1
    return np.multiply.accumulate(made)


class Hashes:
    """Hashes of any stretch of code points from sums up to each place."""

    def __init__(self, points: np.ndarray, salt: int):
        n = len(points)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(scrambled(points, salt) * powers(BASE, n), out=self.sums[1:])
        self.back = powers(INVERSE, n + 1)

    def of(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.back[start]


def points_of(texts: pa.Array) -> np.ndarray:
    """All code points of an array of strings, one text behind the other."""
    data = b"".join(texts.cast(pa.large_binary()).to_pylist())
    return np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)


class Lattice:
    """The table of pieces for lookups by hash, made once in a worker."""

    FILTER_BITS = 22

    def __init__(self, pieces: Pieces):
        self.merger = Merger(pieces)
        texts = [text for text, _, _ in pieces.table]
        ranks = {s: r for r, s in enumerate(sorted({-s for _, s, _ in pieces.table}))}
        sizes = np.array([len(t) for t in texts], np.int64)
        points = points_of(pa.array(texts, pa.string()))
        start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        first, second = (Hashes(points, salt).of(start, sizes) for salt in SALTS)
        order = np.argsort(first)
        self.first, self.second, self.sizes = first[order], second[order], sizes[order]
        self.ranks = np.array([ranks[-s] for _, s, _ in pieces.table], np.int64)[order]
        self.ids = np.array([i for _, _, i in pieces.table], np.int64)[order]
        self.scores = np.array([s for _, s, _ in pieces.table], np.float64)[order]
        if (self.first[1:] == self.first[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.longest = int(sizes.max(initial=1))
        #: Most substrings are no piece; this tells most of them at once.
        self.maybe = np.zeros(1 << self.FILTER_BITS, bool)
        self.maybe[self.first >> np.uint64(64 - self.FILTER_BITS)] = True
        octets = {i: bytes([o]) for o, i in enumerate(pieces.byte_ids)}
        known = {i: text.encode() for text, _, i in pieces.table}
        last = max([*octets, *known], default=0)
        self.texts = pa.array(
            [known.get(i) or octets.get(i, b"") for i in range(last + 1)], pa.large_binary()
        )

    def lookup(self, first: np.ndarray) -> np.ndarray:
        """The row of the piece that has a hash, or -1."""
        maybe = np.flatnonzero(self.maybe[first >> np.uint64(64 - self.FILTER_BITS)])
        row = np.full(len(first), -1)
        at = np.searchsorted(self.first, first[maybe])
        at[at == len(self.first)] = 0
        found = self.first[at] == first[maybe] if len(self.first) else np.zeros(len(maybe), bool)
        row[maybe[found]] = at[found]
        return row

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words one behind the other, and where those of each word begin."""
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        long = np.flatnonzero(sizes > MAX_CHARS)
        short = np.flatnonzero(sizes <= MAX_CHARS)
        ids, counts = self.encode_short(words.take(pa.array(short)), sizes[short])
        all_counts = np.zeros(len(words), np.int64)
        all_counts[short] = counts
        queued = [self.merger.encode(words[int(i)].as_py()) for i in long]
        all_counts[long] = [len(q) for q in queued]
        begins = np.concatenate([[0], np.cumsum(all_counts)])
        made = np.zeros(begins[-1], np.int32)
        made[positions(begins[:-1][short], counts)] = ids
        for i, q in zip(long, queued):
            made[begins[i] : begins[i + 1]] = q
        return made, begins

    def encode_short(self, words: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        points = points_of(words)
        begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        word_of = np.repeat(np.arange(len(sizes)), sizes)
        hashes = [Hashes(points, salt) for salt in SALTS]
        state = self.merged(points, begins, word_of, hashes)
        # A piece begins wherever a boundary is left.
        place = np.arange(len(points)) - begins[word_of]
        start = np.flatnonzero((state[word_of] >> place) & 1)
        length = np.diff(np.append(start, len(points)))
        row = self.lookup(hashes[0].of(start, length))
        ids, counts = self.ids_of(points, start, row)
        per_word = np.bincount(word_of[start], counts, len(sizes)).astype(np.int64)
        return ids, per_word

    def ids_of(
        self, points: np.ndarray, start: np.ndarray, row: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces by row (-1: none), and how many each has."""
        known = row >= 0
        # Only single characters can be no piece; their bytes are.
        counts = np.ones(len(start), np.int64)
        characters = {int(p): self.merger.char(chr(p)) for p in np.unique(points[start[~known]])}
        counts[~known] = [len(characters[int(p)]) for p in points[start[~known]]]
        offsets = np.concatenate([[0], np.cumsum(counts)])
        ids = np.zeros(offsets[-1], np.int32)
        ids[offsets[:-1][known]] = self.ids[row[known]]
        for at, p in zip(offsets[:-1][~known], points[start[~known]]):
            octets = characters[int(p)]
            ids[at : at + len(octets)] = octets
        return ids, counts

    def merged(
        self, points: np.ndarray, begins: np.ndarray, word_of: np.ndarray, hashes: list[Hashes]
    ) -> np.ndarray:
        """For every word the boundaries between its pieces, as bits, when no merge is left."""
        sizes = np.diff(begins)
        state = (np.int64(1) << (sizes + 1)) - 1
        start, row, length = self.edges(points, begins, word_of, hashes)
        word = word_of[start]
        order = np.lexsort([start, self.ranks[row], word])
        word, begin, length = word[order], (start - begins[word_of[start]])[order], length[order]
        ends = (np.int64(1) << begin) | (np.int64(1) << (begin + length))
        inside = ((np.int64(1) << length) - 2) << begin
        while len(word):
            now = state[word]
            within = now & inside
            # Both ends are boundaries and one boundary is between: the edge joins two pieces.
            open_ = ((now & ends) == ends) & (within != 0)
            ready = np.flatnonzero(open_ & ((within & (within - 1)) == 0))
            of = word[ready]
            best = ready[np.append(True, of[1:] != of[:-1])] if len(ready) else ready
            state[word[best]] &= ~inside[best]
            # Boundaries do not come back; a word without a merge is done.
            going = np.zeros(len(state), bool)
            going[word[best]] = True
            stays = open_ & going[word]
            word, ends, inside = word[stays], ends[stays], inside[stays]
        return state

    def edges(
        self, points: np.ndarray, begins: np.ndarray, word_of: np.ndarray, hashes: list[Hashes]
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of two characters or more in the words: start, row and length."""
        room = begins[1:][word_of] - np.arange(len(points))
        starts, rows = [], []
        at = np.arange(len(points))
        for length in range(2, self.longest + 1):
            at = at[room[at] >= length]
            if not len(at):
                break
            row = self.lookup(hashes[0].of(at, length))
            hit = np.flatnonzero(row >= 0)
            starts.append(at[hit])
            rows.append(row[hit])
        none = np.zeros(0, np.int64)
        start, row = np.concatenate([none, *starts]), np.concatenate([none, *rows])
        length = self.sizes[row]
        sure = self.second[row] == hashes[1].of(start, length)
        return start[sure], row[sure], length[sure]

    def best_paths(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, but the ids of the path with the highest sum of scores (Viterbi).

        Boundaries are reached from left to right, in all words at once; each keeps its best sum and
        the edge that ends there, of equal sums the one that begins first. A character that is no piece
        is an edge ``UNKNOWN_PENALTY`` below the worst score, and its bytes are its ids. Some
        ``PATH_CHARS`` characters of words are looked at together.
        """
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // PATH_CHARS
        cuts = np.flatnonzero(np.diff(group, prepend=-1, append=np.iinfo(np.int64).max)).tolist()
        made = [self.paths_of(words.slice(a, b - a), sizes[a:b]) for a, b in zip(cuts, cuts[1:])]
        ids = np.concatenate([np.zeros(0, np.int32), *(ids for ids, _ in made)])
        counts = np.concatenate([np.zeros(1, np.int64), *(counts for _, counts in made)])
        return ids, np.cumsum(counts)

    def paths_of(self, words: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the best paths of words, one behind the other, and how many each word has."""
        points = points_of(words)
        begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        word_of = np.repeat(np.arange(len(sizes)), sizes)
        hashes = [Hashes(points, salt) for salt in SALTS]
        start, row, length = self.edges(points, begins, word_of, hashes)
        single = np.arange(len(points))
        start = np.concatenate([start, single])
        row = np.concatenate([row, self.lookup(hashes[0].of(single, 1))])
        length = np.concatenate([length, np.ones(len(points), np.int64)])
        place = start + length - begins[word_of[start]]
        order = np.lexsort([start, start + length, place])
        start, row, length, place = start[order], row[order], length[order], place[order]
        least = self.scores.min(initial=0.0) - UNKNOWN_PENALTY
        score = np.where(row >= 0, self.scores[row], least)
        # A word of n characters has n + 1 boundaries.
        left = start + word_of[start]
        right = left + length
        best, back = np.zeros(len(points) + len(sizes)), np.zeros(len(points) + len(sizes), np.int64)
        steps = np.append(np.flatnonzero(np.diff(place, prepend=0)), len(place))
        for a, b in zip(steps.tolist(), steps[1:].tolist()):
            total = best[left[a:b]] + score[a:b]
            first = np.flatnonzero(np.diff(right[a:b], prepend=-1))
            top = np.maximum.reduceat(total, first)
            hit = np.flatnonzero(total == np.repeat(top, np.diff(np.append(first, b - a))))
            at = right[a:b][hit]
            kept = hit[np.diff(at, prepend=-1) != 0]
            best[right[a + kept]], back[right[a + kept]] = top, a + kept
        origin = begins[:-1] + np.arange(len(sizes))
        now, made = origin + sizes, []
        while True:
            going = now > origin
            now, origin = now[going], origin[going]
            if not len(now):
                break
            made.append(back[now])
            now = left[made[-1]]
        chosen = np.concatenate([np.zeros(0, np.int64), *made])
        chosen = chosen[np.argsort(start[chosen])]
        ids, counts = self.ids_of(points, start[chosen], row[chosen])
        return ids, np.bincount(word_of[start[chosen]], counts, len(sizes)).astype(np.int64)


def positions(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``begins[i]`` to ``begins[i] + counts[i] - 1`` for every i, one behind the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(begins - before, counts) + np.arange(counts.sum())


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts as the model reads them, and how many each text has.

    A text begins with a mark and has a mark for every blank. A word is a line end, or marks with
    what follows up to the next mark or line end, or what stands at the start of a line.
    """
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    marked = pc.binary_join_element_wise(
        pa.scalar(MARK, pa.large_string()),
        pc.replace_substring(plain, " ", MARK),
        pa.scalar("", pa.large_string()),
    )
    empty = pc.equal(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)
    sizes = np.where(empty, 0, pc.binary_length(marked).to_numpy(zero_copy_only=False))
    data = b"".join(pc.if_else(pa.array(empty), "", marked).cast(pa.large_binary()).to_pylist())
    octets = np.frombuffer(data, np.uint8)
    begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    n = len(octets)
    line_end = octets == 0x0A
    mark = np.zeros(n, bool)
    sign = MARK.encode()
    if n > 2:
        mark[:-2] = (octets[:-2] == sign[0]) & (octets[1:-1] == sign[1]) & (octets[2:] == sign[2])
    first = line_end.copy()
    first[1:] |= line_end[:-1]
    after_mark = np.zeros(n, bool)
    after_mark[3:] = mark[:-3]
    first |= mark & ~after_mark
    first[begins[:-1][sizes > 0]] = True
    offsets = np.append(np.flatnonzero(first), n).astype(np.int64)
    words = pa.Array.from_buffers(
        pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    )
    return words, np.diff(np.searchsorted(offsets[:-1], begins))


def encode(
    documents: DataFrame,
    pieces: Pieces,
    id_column: str = "doc_id",
    text_column: str = "text",
    paths: bool = False,
) -> DataFrame:
    """``_id, _text, ids, decoded`` for every row of ``documents``: the ids that the model's own
    encoder gives for the whole text, and the text that they decode to. With ``paths`` also
    ``path_ids``, those of the path of the highest sum of scores through the same lattice, and
    ``path_agrees``, whether they decode to the same text.

    Decoding gives back every text but one with a mark (U+2581) in it, which becomes a blank. NULL
    and empty texts have no pieces (``_text`` keeps NULL; ``decoded`` is then empty). Repeated rows
    are encoded each, and rows without an id like others. An empty table gives no rows; other columns
    are not read. Rows do not move.
    """
    shared = documents.sparkSession.sparkContext.broadcast(pieces)
    read = documents.select(
        F.col(id_column).cast("bigint").alias("_id"), F.col(text_column).alias("_text")
    )

    schema = "_id BIGINT, _text STRING, ids ARRAY<INT>, decoded STRING"
    schema += ", path_ids ARRAY<INT>, path_agrees BOOLEAN" if paths else ""
    names = [column.split()[0] for column in schema.split(", ")]

    def answer(batch: pa.RecordBatch, lattice: Lattice) -> pa.RecordBatch:
        texts = batch.column(1)
        words, n_words = words_of(texts)
        coded = words.dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False)

        def of_texts(ids: np.ndarray, begins: np.ndarray) -> tuple[pa.Array, pa.Array]:
            counts = np.diff(begins)[number]
            flat = ids[positions(begins[:-1][number], counts)]
            upto = np.concatenate([[0], np.cumsum(counts)])
            cuts = upto[np.concatenate([[0], np.cumsum(n_words)])]
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int32()))
            return lists, decoded(flat, cuts, lattice)

        columns = [batch.column(0), texts, *of_texts(*lattice.encode(coded.dictionary))]
        if paths:
            lists, again = of_texts(*lattice.best_paths(coded.dictionary))
            columns += [lists, pc.equal(again, columns[-1])]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0)
            group = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64) // GROUP_BYTES
            cuts = np.flatnonzero(np.diff(group, prepend=-1, append=np.iinfo(np.int64).max))
            for a, b in zip(cuts, cuts[1:]):
                yield answer(batch.slice(a, b - a), lattice)

    return read.mapInArrow(run, schema)


def decoded(ids: np.ndarray, cuts: np.ndarray, lattice: Lattice) -> pa.Array:
    """The texts of lists of ids; the blank that encoding puts in front is taken away."""
    parts = lattice.texts.take(pa.array(ids))
    sizes = pc.binary_length(parts).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes)])[cuts].astype(np.int64)
    data = parts.buffers()[2] or pa.py_buffer(b"")
    whole = pa.Array.from_buffers(
        pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(offsets), data]
    )
    blanks = pc.replace_substring(whole, MARK, " ")
    return pc.utf8_slice_codeunits(blanks, 1).cast(pa.string())
