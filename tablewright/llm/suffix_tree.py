"""Language model scores from a probabilistic suffix tree.

States of the tree are contexts of one to ``DEPTH`` words. A context is a candidate when the training
texts hold it ``MIN_COUNT`` times, whatever their size, so the tree grows with the corpus. It passes
when the words that follow it are distributed otherwise than those that follow its suffix: when their
divergence, less what sampling alone would give, is at least ``MIN_DIVERGENCE``. States are the
contexts that pass and all their suffixes. The distribution of a state is smoothed with that of its
suffix (Witten and Bell: as much weight as it has distinct next words), the empty context with half a
count for every word and one unknown word, so each distribution sums to one. A token is scored by the
longest state that the words before it end with.

Counts and states are rows of tables in parts by hash, never on the driver and never broadcast. Texts
lie in blocks, see :mod:`tablewright.llm.blocks`, which give and ask in three rounds:

1. words and pairs of words, each distinct one once a block, and their counts over all training texts;
2. longer runs of words, those alone whose context consists of frequent pairs: a longer context
   cannot be more frequent than a pair in it;
3. the candidates in a block, with the block's share of their divergence. A part adds the shares up,
   tells the parts of all suffixes of a context that passes, and answers which candidates are states.

A run of words is the pair of a context and its next word, so its count is both that of the next word
and, if no text ends there, of the context that is one word longer. The divergence of a context is a
sum over its next words, each as often as it occurs; so every block can add up its own occurrences,
and 1 / count over occurrences counts the different next words. Shares are added as whole numbers:
the order of the blocks changes nothing. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.blocks import expand_numbers, n_blocks, packed, squeeze_numbers, unpacked
from tablewright.llm.common import stage_and_free

DEPTH = 4  # words of the longest context
MIN_COUNT = 20
MIN_DIVERGENCE = 0.02
BLOCK_BYTES = 2 << 20  # of text that a task holds at once
PART_BYTES = 6 << 20  # of text for each part of the tables of counts
LEAST_PARTS = 48
SCORES, LEARNS = 1, 2  # what a row is for
UNIT = 2.0**16  # shares of a block are whole multiples of 1 / UNIT

_RNG = np.random.default_rng(99)
_LETTERS = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 18
END = np.uint64(0x5851F42D4C957F2D)
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _joined(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The hash of a context that is one word longer than ``rest``."""
    return _mixed(first * np.uint64(0xE7037ED1A0B428DB) + rest)


def _powers(base: int, n: int) -> np.ndarray:
    made = np.full(n, base, np.uint64)
    made[0] = 1
    return np.multiply.accumulate(made)


class Hasher:
    """Hashes of the words of texts, all letters of a piece of text at once."""

    def __init__(self):
        self.up, self.down = _powers(_BASE, _PIECE), _powers(_INVERSE, _PIECE)

    def words(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where each word starts, and its hash."""
        starts, hashes, at = [], [], 0
        while at < len(text):
            end = min(len(text), at + _PIECE)
            # A piece ends where a word does.
            while end < len(text) and not _SPACES[text[end]]:
                end += 1
            piece = np.frombuffer(text, np.uint8, end - at, at)
            if len(piece) > len(self.up):
                self.up, self.down = _powers(_BASE, len(piece)), _powers(_INVERSE, len(piece))
            space = _SPACES[piece]
            edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
            first, last = edge[::2], edge[1::2]
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_LETTERS[piece] * self.up[: len(piece)], out=sums[1:])
            hashed = (sums[last] - sums[first]) * self.down[first]
            starts.append(first + at)
            hashes.append(_mixed(hashed + (last - first).astype(np.uint64)))
            at = end
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(starts), np.concatenate(hashes)

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of every text and then one end: hashes, place in the text, tokens per text."""
        lengths = np.array([len(t) + 1 for t in texts])
        starts, hashes = self.words(b"\n".join(texts).lower())
        bounds = np.append(0, np.cumsum(lengths))
        words = np.diff(np.searchsorted(starts, bounds))
        per_text = words + 1
        ends = np.cumsum(per_text) - 1
        out = np.empty(int(per_text.sum()), np.uint64)
        is_word = np.ones(len(out), bool)
        is_word[ends] = False
        out[ends], out[is_word] = END, hashes
        place = np.arange(len(out)) - np.repeat(ends - words, per_text)
        return out, place, per_text


def _part(hashed: np.ndarray, parts: int) -> np.ndarray:
    """Equal ranges of the hash, so that what is sorted by it is cut into parts."""
    return ((hashed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _cut(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edges = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        yield int(part[a]), a, b


def _steps(sorted_numbers: np.ndarray) -> bytes:
    return squeeze_numbers(np.diff(sorted_numbers, prepend=np.uint64(0)))


def _sums(steps: bytes) -> np.ndarray:
    return np.cumsum(expand_numbers(steps, "<u8"), dtype=np.uint64)


def _rows(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"INT": pa.int32(), "BIGINT": pa.int64(), "BINARY": pa.binary(), "DOUBLE": pa.float64()}
    names, types = zip(*(column.split() for column in schema.split(", ")))
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.table({n: pa.array(c, kinds[t]) for n, c, t in zip(names, columns, types)})


def _folded(numbers: np.ndarray) -> np.ndarray:
    """Numbers of either sign as numbers from 0 on, whose high bytes are zeros."""
    return 2 * np.abs(numbers) + (numbers < 0)


def _unfolded(numbers: np.ndarray) -> np.ndarray:
    return np.where(numbers & 1, -(numbers >> 1), numbers >> 1)


class _Block:
    """The tokens of a block, the hashes of the runs of words that end at each, and the counts that
    it has heard. ``grams[k]`` and ``counts[k]`` are of runs of k words; 0 where there is none."""

    def __init__(self, table: pa.Table, depth: int, min_count: int):
        is_text = table.column("_blob").is_valid()
        rows = unpacked(table.filter(is_text).column("_blob").to_pylist())
        self.ids, texts, uses = rows
        self.min_count = min_count
        self.tokens, self.place, self.per_text = Hasher().tokens(texts)
        uses = np.array(uses, np.int64)
        self.scored = (uses & SCORES) > 0
        self.learns = np.repeat((uses & LEARNS) > 0, self.per_text)
        self.grams = {1: self.tokens}
        # Nothing that the block holds refers to it: it is freed with its last use, and not when Python
        # happens to look for cycles, which a few large arrays do not bring about.
        n = len(self.tokens)
        self.counts = defaultdict(lambda: np.zeros(n, np.int64))
        self.own = {}
        self.index = defaultdict(lambda: np.zeros(n, np.int32))
        self._distinct, self._at = {}, {1: np.arange(len(self.tokens), dtype=np.int32)}
        if "_counts" in table.column_names:
            heard = table.filter(table.column("_counts").is_valid())
            heard = heard.sort_by([("_length", "ascending"), ("_part", "ascending")])
            length = heard.column("_length").to_numpy()
            answers = heard.column("_counts").to_pylist()
            for k in np.unique(length).tolist():
                mine = np.flatnonzero(length == k)
                told = np.concatenate([_unfolded(expand_numbers(answers[i], "<i8")) for i in mine])
                inverse = self.distinct(k)[1]
                told = told[inverse]
                self.counts[k][self.at(k)] = np.abs(told)
                self.own[k] = np.zeros(len(self.tokens), bool)
                self.own[k][self.at(k)] = told < 0
                if k <= depth:
                    self.index[k] = np.zeros(len(self.tokens), np.int32)
                    self.index[k][self.at(k)] = inverse
                del self._distinct[k], inverse

    def at(self, length: int) -> np.ndarray:
        """The tokens that end a run of ``length`` words which is asked for: the pairs that the run
        without its last word consists of are all frequent."""
        if length not in self._at:
            at = self.at(length - 1)
            at = at[self.place[at] >= length - 1]
            if length > 2:
                at = at[self.counts[2][at - length + 2] >= self.min_count]
            self._at[length] = at
            made = np.zeros(len(self.tokens), np.uint64)
            made[at] = _joined(self.tokens[at - length + 1], self.grams[length - 1][at])
            self.grams[length] = made
        return self._at[length]

    def distinct(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        if length not in self._distinct:
            at = self.at(length)
            self._distinct[length] = np.unique(self.grams[length][at], return_inverse=True)
        return self._distinct[length]

    def questions(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct runs of ``length`` words, and how often the training texts of the block have them."""
        kinds, inverse = self.distinct(length)
        mine = inverse[self.learns[self.at(length)]]
        return kinds, np.bincount(mine, minlength=len(kinds)).astype(np.int64)

    def candidates(self, length: int) -> np.ndarray:
        """The tokens that follow a candidate of ``length`` words."""
        at = self.at(length + 1)
        return at[self.counts[length][at - 1] >= self.min_count]

    def contexts(self, length: int) -> tuple[np.ndarray, ...]:
        """The candidates of one length in the order of their hashes, a token that ends each, the
        tokens that follow one, and which."""
        at = self.candidates(length)
        kind = self.index[length][at - 1]
        last = np.full(kind.max(initial=-1) + 1, -1, np.int32)
        last[kind] = at - 1
        found = last >= 0
        inverse = (np.cumsum(found, dtype=np.int32) - np.int32(1))[kind]
        last = last[found]
        return self.grams[length][last], last, at, inverse

    def follows(self, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length, the tokens that follow a candidate and the number of that candidate in
        the order of :func:`facts`."""
        contexts = [self.contexts(length) for length in range(1, depth + 1)]
        order = np.argsort(np.concatenate([keys for keys, _, _, _ in contexts]))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        done, placed = 0, []
        for keys, _, at, inverse in contexts:
            placed.append((at, rank[done : done + len(keys)][inverse]))
            done += len(keys)
        return placed

    def facts(self, depth: int, n_tokens: int) -> tuple[np.ndarray, ...]:
        """The candidates of the block in the order of their hashes: hash, shares of the divergence
        and of the different next words, and which of them the block speaks for; of these the count,
        the count of the suffix, and the hashes of the shorter suffixes (0: none)."""
        chains, shares, kinds, owns, counts, ups = [], [], [], [], [], []
        contexts = [self.contexts(length) for length in range(1, depth + 1)]
        for length, (keys, last, at, inverse) in enumerate(contexts, 1):
            learnt = self.learns[at]
            mine, token = inverse[learnt], at[learnt]
            n = self.counts[length + 1][token]
            gain = np.log(n / self.counts[length][token])
            shares.append(np.bincount(mine, gain, len(keys)))
            kinds.append(np.bincount(mine, 1 / n, len(keys)))
            owns.append(self.own[length][last] if len(last) else np.zeros(0, bool))
            last = last[owns[-1]]
            counts.append(self.counts[length][last])
            ups.append(self.counts[length - 1][last] if length > 1 else np.full(len(last), n_tokens))
            chain = np.zeros((len(last), depth), np.uint64)
            for shorter in range(1, length):
                chain[:, shorter - 1] = self.grams[shorter][last]
            chains.append(chain)
        key = np.concatenate([keys for keys, _, _, _ in contexts])
        order = np.argsort(key)
        whole = [np.rint(np.concatenate(x)[order] * UNIT).astype(np.int64) for x in (shares, kinds)]
        own = np.concatenate(owns)
        spoken = np.argsort(key[own])
        own = own[order]
        of_own = [np.concatenate(x)[spoken] for x in (counts, ups, chains)]
        return key[order], *whole, own, *of_own


_ASKED = "_part INT, _block INT, _length INT, _keys BINARY, _counts BINARY"
_COUNTED = "_block INT, _part INT, _length INT, _counts BINARY, _n BIGINT, _kinds BIGINT"


def _ask(lengths: range, parts: int, depth: int, min_count: int):
    """Round 1 and 2: the runs of words of a block, in parts by hash."""

    def run(table: pa.Table) -> pa.Table:
        number = table.column("_block")[0].as_py()
        block = _Block(table, depth, min_count)
        rows = []
        for length in lengths:
            keys, n = block.questions(length)
            rows += [
                (p, number, length, _steps(keys[a:b]), squeeze_numbers(n[a:b]))
                for p, a, b in _cut(_part(keys, parts))
            ]
        return _rows(_ASKED, rows)

    return run


def _count(table: pa.Table) -> pa.Table:
    """The counts of a part for the blocks that ask, in their order, below zero for the one block
    that is to speak for the run in round 3; under no block, how many single tokens there are and
    how many different ones."""
    part = table.column("_part")[0].as_py()
    rows = []
    for length in table.column("_length").unique().to_pylist():
        mine = table.filter(pc.equal(table.column("_length"), length))
        keys = [_sums(x) for x in mine.column("_keys").to_pylist()]
        given = [expand_numbers(x, "<i8") for x in mine.column("_counts").to_pylist()]
        distinct, first, inverse = np.unique(
            np.concatenate(keys), return_index=True, return_inverse=True
        )
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, inverse, np.concatenate(given))
        if length == 1:
            rows.append((None, part, None, None, int(total.sum()), int((total > 0).sum())))
        told, done = total[inverse], 0
        told[first] *= -1
        for block, k in zip(mine.column("_block").to_pylist(), keys):
            answer = squeeze_numbers(_folded(told[done : done + len(k)]))
            done += len(k)
            rows.append((block, part, length, answer, None, None))
    return _rows(_COUNTED, rows)


_SHARED = (
    "_part INT, _block INT, _keys BINARY, _gain BINARY, _kinds BINARY, _own BINARY, _n BINARY, "
    "_up BINARY, _chain BINARY"
)
_TESTED = "_part INT, _block INT, _keys BINARY, _kinds BINARY, _state BINARY"
_TOLD = "_block INT, _part INT, _states BINARY"


def _share(parts: int, depth: int, min_count: int, n_tokens: int):
    """Round 3: the candidates of a block, with its shares."""

    def run(table: pa.Table) -> pa.Table:
        number = table.column("_block")[0].as_py()
        block = _Block(table, depth, min_count)
        keys, gain, kinds, own, n, up, chain = block.facts(depth, n_tokens)
        spoken, rows = np.append(0, np.cumsum(own)), []
        for p, a, b in _cut(_part(keys, parts)):
            mine = slice(spoken[a], spoken[b])
            of_all = (gain[a:b], kinds[a:b], own[a:b].astype("<i4"))
            of_own = (n[mine], up[mine], chain[mine].reshape(-1))
            rows.append((p, number, _steps(keys[a:b]), *map(squeeze_numbers, of_all + of_own)))
        return _rows(_SHARED, rows)

    return run


def _test(parts: int, depth: int, min_divergence: float):
    """The candidates of a part: which pass, and for the parts of their suffixes, that these are
    states. What the blocks ask is passed on as places among the candidates of the part."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("_part")[0].as_py()

        def column(name, kind):
            return np.concatenate([expand_numbers(x, kind) for x in table.column(name).to_pylist()])

        asked = [_sums(x) for x in table.column("_keys").to_pylist()]
        cuts = np.cumsum([0, *map(len, asked)]).tolist()
        asked = np.concatenate(asked)
        keys, inverse = np.unique(asked, return_inverse=True)
        del asked
        share = np.zeros((2, len(keys)), np.int64)
        np.add.at(share[0], inverse, column("_gain", "<i8"))
        np.add.at(share[1], inverse, column("_kinds", "<i8"))
        # One block speaks for each candidate.
        spoken = inverse[column("_own", "<i4") > 0]
        order = np.argsort(spoken)
        n, up = column("_n", "<i8")[order], column("_up", "<i8")[order]
        kinds = np.rint(share[1] / UNIT).astype(np.int64)
        divergence = share[0] / UNIT / n - np.log(n / up)
        passes = divergence - (kinds - 1) / (2 * n) >= min_divergence
        chain = column("_chain", "<u8").reshape(-1, depth)[order][passes]
        suffixes = np.unique(chain[chain > 0])
        rows = [(part, None, _steps(keys), squeeze_numbers(kinds), squeeze_numbers(passes.astype("<i4")))]
        rows += [(p, None, _steps(suffixes[a:b]), None, None) for p, a, b in _cut(_part(suffixes, parts))]
        for block, a, b in zip(table.column("_block").to_pylist(), cuts, cuts[1:]):
            rows.append((part, block, _steps(inverse[a:b].astype(np.uint64)), None, None))
        return _rows(_TESTED, rows)

    return run


def _tell(table: pa.Table) -> pa.Table:
    """For the candidates that the blocks ask for: how many different words follow, 0 if it is no
    state."""
    part = table.column("_part")[0].as_py()
    rows = table.to_pylist()
    (own,) = (r for r in rows if r["_kinds"] is not None)
    keys, kinds = _sums(own["_keys"]), expand_numbers(own["_kinds"], "<i8")
    state = expand_numbers(own["_state"], "<i4") > 0
    for r in rows:
        if r["_block"] is None and r["_kinds"] is None:
            state[np.searchsorted(keys, _sums(r["_keys"]))] = True
    told = np.where(state, kinds, 0)
    asked = ((r["_block"], _sums(r["_keys"])) for r in rows if r["_block"] is not None)
    return _rows(
        _TOLD, [(b, part, squeeze_numbers(told[x.astype(np.int64)])) for b, x in asked]
    )


_SCORES = (
    "_id BIGINT, n_tokens BIGINT, n_known BIGINT, train_tokens BIGINT, base_score DOUBLE, "
    "score DOUBLE, n_in_states BIGINT"
)


def _score(depth: int, min_count: int, n_tokens: int, n_words: int):
    def run(table: pa.Table) -> pa.Table:
        block = _Block(table, depth, min_count)
        follows, told = [], np.zeros(0, np.int64)
        if depth:
            follows = block.follows(depth)
            answers = table.filter(table.column("_states").is_valid()).sort_by([("_part", "ascending")])
            parts = [expand_numbers(x, "<i8") for x in answers.column("_states").to_pylist()]
            told = np.concatenate([told, *parts])
        seen = block.counts[1]
        base = (seen + 0.5) / (n_tokens + 0.5 * (n_words + 1))
        p, in_state = base.copy(), np.zeros(len(base), np.int64)
        # From short to long contexts; the longest state has the last word.
        for length, (at, candidate) in enumerate(follows, 1):
            kinds = told[candidate]
            at, kinds = at[kinds > 0], kinds[kinds > 0]
            n = block.counts[length][at - 1]
            p[at] = (block.counts[length + 1][at] + kinds * p[at]) / (n + kinds)
            in_state[at] = 1
        first = np.cumsum(block.per_text) - block.per_text
        add = np.add.reduceat
        made = pa.table(
            {
                "_id": pa.array(block.ids, pa.int64()),
                "n_tokens": block.per_text.astype(np.int64),
                "n_known": add((seen > 0).astype(np.int64), first),
                "train_tokens": np.full(len(first), n_tokens),
                "base_score": add(np.log10(base), first),
                "score": add(np.log10(p), first),
                "n_in_states": add(in_state, first),
            }
        )
        return made.filter(pa.array(block.scored))

    return run


def held_out(id_column: Column, of: int = 5, rest: int = 1) -> Column:
    """Rows that are kept from training, by the CRC-32 of their id as text."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % of == rest, F.lit(False))


def _used(documents: DataFrame, training, id_column: str, text_column: str) -> DataFrame:
    """``_id, _text, _use``: rows to score, to learn from, or both."""

    def rows(df, use):
        return df.select(
            F.col(id_column).cast("bigint").alias("_id"),
            F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("_text"),
            use.cast("int").alias("_use"),
        )

    if isinstance(training, DataFrame):
        return rows(documents, F.lit(SCORES)).unionAll(rows(training, F.lit(LEARNS)))
    learns = F.lit(True) if training is None else F.coalesce(training, F.lit(False))
    return rows(documents, F.when(learns, SCORES + LEARNS).otherwise(SCORES))


def score_texts(
    documents: DataFrame,
    training: DataFrame | Column | None = None,
    depth: int = DEPTH,
    min_count: int = MIN_COUNT,
    min_divergence: float = MIN_DIVERGENCE,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``_id, n_tokens, n_known, train_tokens, base_score, score, n_in_states`` for every row of
    ``documents``.

    The tree is learned from ``training``: a condition on ``documents``, or other rows with the same
    two columns (default: the documents themselves). ``score`` is the log10 probability of the words
    of a text and its end, ``base_score`` that by the empty context alone; ``n_known`` counts tokens
    that training has, ``n_in_states`` those that a context of one word or more scores. Words are
    parted by white space and compared with A to Z in lower case.

    NULL and empty texts are an end alone. Without training text every token has the probability of
    an unknown word, which is then 1. Repeated rows are scored, and learned, each. An empty table
    gives no rows; other columns are not read. The counts are made when this is called.
    """
    texts = _used(documents, training, id_column, text_column)
    n_bytes = texts.agg(F.coalesce(F.sum(F.octet_length("_text") + 1), F.lit(0))).first()[0]
    dealt = packed(texts, n_blocks(n_bytes, BLOCK_BYTES))
    parts = max(LEAST_PARTS, -(-n_bytes // PART_BYTES))

    def blocks(*heard: DataFrame):
        known = dealt
        for answers in heard:
            known = known.unionByName(answers.where("_block IS NOT NULL"), allowMissingColumns=True)
        return known.groupBy("_block")

    def count(lengths: range, *heard: DataFrame):
        asked = blocks(*heard).applyInArrow(_ask(lengths, parts, depth, min_count), _ASKED)
        counted = asked.groupBy("_part").applyInArrow(_count, _COUNTED)
        return stage_and_free(counted, "suffix-tree-counts")

    pairs = min(depth + 1, 2)
    counts = count(range(1, pairs + 1))
    n_tokens, n_words = counts.where("_block IS NULL").agg(F.sum("_n"), F.sum("_kinds")).first()
    n_tokens, n_words = n_tokens or 0, n_words or 0
    heard = [counts.select("_block", "_part", "_length", "_counts")]
    if depth > 1:
        counts = count(range(3, depth + 2), *heard)
        heard.append(counts.select("_block", "_part", "_length", "_counts"))
    if depth:
        told = (
            blocks(*heard)
            .applyInArrow(_share(parts, depth, min_count, n_tokens), _SHARED)
            .groupBy("_part")
            .applyInArrow(_test(parts, depth, min_divergence), _TESTED)
            .groupBy("_part")
            .applyInArrow(_tell, _TOLD)
        )
        heard.append(stage_and_free(told, "suffix-tree-states"))
    return blocks(*heard).applyInArrow(_score(depth, min_count, n_tokens, n_words), _SCORES)
