"""Toxic spans by a linear-chain conditional random field over words.

Each word is tagged clean or toxic. Its features are the word itself, the one before and the one
after (in lower case, without marks and digits at the ends); neighbouring tags are joined by four
transition weights. Documents are labelled as wholes, so words are labelled first: a word is toxic in
a toxic document if it stands in toxic documents far more often than chance allows (a bound over all
words tested). Copies of a document, and a document that says a word over and over, count once: each
pair of neighbouring words belongs to one text that has it, and the texts are counted that a word's
pairs belong to. The field is fitted to these labels by gradient ascent on its likelihood.

The forward-backward marginals of a document give its score, through a logistic curve over the
greatest marginal and the expected number of toxic words, which is fitted to the document labels of
texts that the field has not seen; and its spans, the stretches of words of a marginal of one half or
more.

Fitting reads a sample of about ``PER_CLASS`` distinct texts of each label, drawn by a hash of the
text. All that comes to the driver is bounded by that sample: its vocabulary, a model per shard, a
row per text that calibrates. Scoring reads every text whole; rows do not move.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import stage, with_free_name
from tablewright.llm.words import WORD, split_words

PER_CLASS = (6000, 3000)  # clean and toxic texts, about, to fit on; a fifth of them calibrates
SHARDS = 4
LEAST_TEXTS = 4  # that a word must stand in to be a feature
CHANCE = 1.0  # a word is toxic by chance in exp(-CHANCE) of all samples
WINDOW = 256  # words of a training sequence
ROUNDS, RATE, RIDGE = 60, 1.0, 1e-2
GROUP_BYTES = 2 << 20
ENDS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789¡¿«»“”„‘’…–—·•"


def features(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, the number of each word in turn, and where each text begins."""
    words, begins = split_words(texts)
    # Case and ends are changed once for each distinct spelling.
    spelled = words.dictionary_encode()
    plain = pc.utf8_trim(pc.utf8_lower(spelled.dictionary), characters=ENDS).dictionary_encode()
    number = plain.indices.to_numpy(zero_copy_only=False)
    return plain.dictionary, number[spelled.indices.to_numpy(zero_copy_only=False)], begins


def forward_backward(
    odds: np.ndarray, begins: np.ndarray, moves: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For every word the odds of toxic against clean from the words up to it, and from those after
    it. ``odds`` are those of the words alone; ``moves`` has the factors of start, clean to toxic,
    toxic to clean and toxic to toxic. Sequences run side by side, the longest first."""
    start, enter, leave, stay = moves
    sizes = np.diff(begins)
    order = np.argsort(-sizes, kind="stable")
    sizes, first = sizes[order], begins[:-1][order]
    steps = int(sizes[0]) if len(sizes) else 0
    # How many sequences have more than t words.
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")
    ahead, behind = np.empty(len(odds)), np.empty(len(odds))
    r = None
    for t in range(steps):
        at = first[: active[t]] + t
        if t:
            r = r[: active[t]]
            r = odds[at] * (enter + stay * r) / (1 + leave * r)
        else:
            r = odds[at] * start
        # Far beyond any certainty; keeps products of certain words finite.
        r = np.clip(r, 1e-30, 1e30)
        ahead[at] = r
    b = np.ones(0)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        new = np.ones(n)
        if len(b):
            e = odds[first[: len(b)] + t + 1] * b
            new[: len(b)] = np.clip((leave + stay * e) / (1 + enter * e), 1e-30, 1e30)
        b = new
        behind[first[:n] + t] = b
    return ahead, behind


@dataclass(frozen=True)
class Model:
    """``weights`` has a row each for a word, the word before and the word after it, with a column
    per word of ``words`` and one more for all others; ``moves`` are logarithms; ``curve`` turns
    what :meth:`Model.aggregated` gives into a score."""

    words: pa.Array = field(default_factory=lambda: pa.array([], pa.large_string()))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((3, 1)))
    bias: float = 0.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros(4))
    curve: np.ndarray | None = None

    def known(self, words: pa.Array) -> np.ndarray:
        """The column of each word."""
        at = pc.fill_null(pc.index_in(words.cast(pa.large_string()), self.words), len(self.words))
        return at.to_numpy(zero_copy_only=False).astype(np.int64)

    def marginals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The probability that each word is toxic, and where each text begins."""
        distinct, number, begins = features(texts)
        columns = self.known(distinct)[number]
        odds = np.exp(np.clip(emissions(columns, begins, self.weights, self.bias), -40, 40))
        ahead, behind = forward_backward(odds, begins, np.exp(self.moves))
        both = ahead * behind
        return both / (1 + both), begins

    def aggregated(self, p: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """A row per text: the log-odds of the greatest marginal, and the logarithm of one more than
        the expected number of toxic words among the likely ones."""
        greatest, expected = np.zeros(len(begins) - 1), np.zeros(len(begins) - 1)
        filled = np.flatnonzero(np.diff(begins))
        if len(filled):
            cuts = begins[:-1][filled]
            greatest[filled] = np.maximum.reduceat(p, cuts)
            expected[filled] = np.add.reduceat(np.where(p >= 0.5, p, 0.0), cuts)
        greatest = np.clip(greatest, 1e-4, 1 - 1e-4)
        return np.stack([np.log(greatest / (1 - greatest)), np.log1p(expected)], axis=1)

    def scores(self, p: np.ndarray, begins: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(begins) - 1)
        return logistic(self.aggregated(p, begins), self.curve)


def emissions(
    columns: np.ndarray, begins: np.ndarray, weights: np.ndarray, bias: float
) -> np.ndarray:
    """The log-odds of each word from its features; texts do not touch."""
    made = bias + weights[0][columns]
    before, after = weights[1][columns], weights[2][columns]
    made[1:] += before[:-1]
    made[:-1] += after[1:]
    inner = begins[1:-1]
    inner = inner[(inner > 0) & (inner < len(columns))]
    inner = np.unique(inner)
    made[inner] -= before[inner - 1]
    made[inner - 1] -= after[inner]
    return made


def logistic(x: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ curve[1:] + curve[0], -30, 30)))


def fit_curve(x: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Intercept and slopes of a weighted logistic regression, by Newton's method."""
    curve = np.zeros(x.shape[1] + 1)
    full = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    for _ in range(30):
        p = logistic(x, curve)
        gradient = full.T @ (weight * (labels - p)) - 0.1 * curve
        bend = (full * (weight * p * (1 - p))[:, None]).T @ full + 0.1 * np.eye(len(curve))
        step = np.linalg.solve(bend, gradient)
        curve = curve + step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
    return curve


def windows(begins: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """The begins of texts, and further ones in texts of more than ``most`` words."""
    cuts = [np.arange(a, b, most) for a, b in zip(begins, begins[1:]) if b > a]
    return np.concatenate([*cuts, begins[-1:]]).astype(np.int64)


def fit_field(
    columns: np.ndarray, begins: np.ndarray, toxic: np.ndarray, n_columns: int
) -> np.ndarray:
    """Weights, bias and moves in one array, by gradient ascent with a step per weight (Adam), steps
    that shrink and a ridge penalty."""
    theta = np.zeros(3 * n_columns + 5)
    slope, squares = np.zeros(len(theta)), np.zeros(len(theta))
    y = toxic.astype(float)
    theta[-5] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    starts = np.zeros(len(columns), bool)
    starts[begins[:-1]] = True
    joined = ~starts[1:]  # a word and the next one are of one sequence
    found = np.zeros(4)
    found[0] = y[starts].sum()
    a, b = y[:-1][joined], y[1:][joined]
    found[1:] = [((1 - a) * b).sum(), (a * (1 - b)).sum(), (a * b).sum()]
    for step in range(1, ROUNDS + 1):
        weights, bias, moves = theta[: 3 * n_columns].reshape(3, n_columns), theta[-5], theta[-4:]
        odds = np.exp(np.clip(emissions(columns, begins, weights, bias), -40, 40))
        factors = np.exp(moves)
        ahead, behind = forward_backward(odds, begins, factors)
        p = ahead * behind
        p = p / (1 + p)
        r, e = ahead[:-1][joined], (odds * behind)[1:][joined]
        pairs = np.stack([factors[1] * e, factors[2] * r, factors[3] * r * e])
        pairs = pairs / (1 + pairs.sum(axis=0))
        off = y - p
        gradient = np.empty_like(theta)
        before, after = np.zeros(len(off)), np.zeros(len(off))
        before[:-1][joined] = off[1:][joined]
        after[1:][joined] = off[:-1][joined]
        for i, part in enumerate((off, before, after)):
            gradient[i * n_columns : (i + 1) * n_columns] = np.bincount(columns, part, n_columns)
        gradient[-5] = off.sum()
        gradient[-4] = found[0] - p[starts].sum()
        gradient[-3:] = found[1:] - pairs.sum(axis=1)
        gradient -= RIDGE * theta
        slope = 0.8 * slope + 0.2 * gradient
        squares = 0.95 * squares + 0.05 * gradient * gradient
        size = np.sqrt(squares / (1 - 0.95**step)) + 1e-8
        rate = RATE * (1 - (step - 1) / ROUNDS)
        theta = np.clip(theta + rate * slope / (1 - 0.8**step) / size, -15, 15)
    return theta


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_word, _before, _toxic, _of``: the pairs of neighbouring words, each with the least hash of
    the texts of the batch that have it and that label."""
    for batch in batches:
        distinct, number, begins = features(batch.column(0))
        if not len(number):
            continue
        label = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), np.diff(begins))
        of = np.repeat(batch.column(2).to_numpy(zero_copy_only=False), np.diff(begins))
        before = np.concatenate([[-1], number[:-1]]).astype(np.int64)
        before[begins[:-1][np.diff(begins) > 0]] = -1
        n = len(distinct) + 1
        key = (number.astype(np.int64) * n + before + 1) * 2 + label
        order = np.lexsort([of, key])
        key, of = key[order], of[order]
        first = np.append(True, key[1:] != key[:-1])
        key, of = key[first], of[first]
        word, at = key // 2 // n, key // 2 % n
        hashed = np.array([0] + [zlib.crc32(w.encode()) for w in distinct.to_pylist()], np.int64)
        yield pa.RecordBatch.from_arrays(
            [distinct.take(pa.array(word)).cast(pa.string()), pa.array(hashed[at]),
             pa.array(key % 2), pa.array(of)],
            ["_word", "_before", "_toxic", "_of"],
        )


def toxic_words(in_toxic: np.ndarray, in_clean: np.ndarray, chance: float = CHANCE) -> np.ndarray:
    """Which words stand in toxic texts more often than chance allows: Chernoff's bound on their
    share against that of all words, for as many words as are tested."""
    total = in_toxic + in_clean
    if not total.sum():
        return np.zeros(len(total), bool)
    base = in_toxic.sum() / total.sum()
    if base in (0, 1):
        return np.zeros(len(total), bool)
    share = in_toxic / total
    with np.errstate(divide="ignore", invalid="ignore"):
        clean = np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0.0)
        far = share * np.log(share / base) + clean
    return (share > max(base, 0.5)) & (total * far >= np.log(len(total)) + chance)


def sample_texts(
    documents: DataFrame,
    labels: DataFrame,
    per_class: tuple[int, int],
    id_column: str,
    text_column: str,
    label_column: str,
) -> tuple[DataFrame, dict[int, int]]:
    """``_text, _toxic, _fifth, _shard`` of about ``per_class`` distinct texts of each label, and how
    many distinct texts each label has."""
    marked = (
        labels.select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("_toxic"))
        .where("_id IS NOT NULL AND _toxic IN (0, 1)")
        .groupBy("_id")
        .agg(F.max("_toxic").alias("_toxic"))
    )
    texts = documents.select(
        F.col(id_column).alias("_id"), F.col(text_column).alias("_text")
    ).where("_id IS NOT NULL AND _text IS NOT NULL")
    hashed = texts.withColumn("_hash", F.xxhash64("_text"))
    known = stage(
        hashed.select("_id", "_hash")
        .join(marked, "_id")
        .groupBy("_hash")
        .agg(F.min("_id").alias("_id"), F.max("_toxic").alias("_toxic")),
        "toxic-known",
    )
    sizes = {r[0]: r[1] for r in known.groupBy("_toxic").agg(F.count(F.lit(1))).collect()}
    unit = 1 << 32
    limit = [min(unit, unit * per_class[c] // max(1, sizes.get(c, 0))) for c in (0, 1)]
    draw = F.pmod(F.xxhash64(F.lit("toxic"), "_hash"), F.lit(unit))
    chosen = known.where(draw < F.when(F.col("_toxic") == 1, limit[1]).otherwise(limit[0]))
    sample = (
        hashed.join(F.broadcast(chosen), ["_id", "_hash"])  # about sum(per_class) rows
        .groupBy("_hash", "_toxic")
        .agg(F.min("_text").alias("_text"))
        .select(
            "_text",
            "_toxic",
            F.pmod(F.xxhash64(F.lit("fifth"), "_hash"), F.lit(5)).alias("_fifth"),
            F.pmod(F.xxhash64(F.lit("shard"), "_hash"), F.lit(SHARDS)).alias("_shard"),
            F.xxhash64(F.lit("order"), "_hash").alias("_order"),
        )
    )
    return stage(sample, "toxic-sample"), sizes


def fit(
    documents: DataFrame,
    labels: DataFrame,
    per_class: tuple[int, int] = PER_CLASS,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> Model:
    """A model from the rows of ``documents`` that have a text and, by their id, a label of 0 or 1.

    An id with both labels is toxic, and so is a text that has both; other labels and rows without an
    id or a text are not used. Without labelled texts the model gives 0 to everything.
    """
    sample, sizes = sample_texts(
        documents, labels, per_class, id_column, text_column, label_column
    )
    fitting = sample.where("_fifth != 0")
    counts = (
        fitting.select("_text", "_toxic", "_order")
        .mapInArrow(contexts, "_word STRING, _before BIGINT, _toxic BIGINT, _of BIGINT")
        .groupBy("_word", "_before", "_toxic")
        .agg(F.min("_of").alias("_of"))
        .groupBy("_word", "_toxic", "_of")
        .agg(F.lit(1).alias("_one"))
        .groupBy("_word")
        .agg(F.sum("_toxic").alias("_in_toxic"), F.sum(1 - F.col("_toxic")).alias("_in_clean"))
        .where(F.col("_in_toxic") + F.col("_in_clean") >= LEAST_TEXTS)
        .where("_word != ''")
        .orderBy("_word")
        .toArrow()  # the vocabulary of the sample
    )
    words = counts.column(0).combine_chunks().cast(pa.large_string())
    if isinstance(words, pa.ChunkedArray):
        words = pa.concat_arrays(words.chunks) if words.num_chunks else pa.array([], pa.large_string())
    toxic = np.append(toxic_words(counts.column(1).to_numpy(), counts.column(2).to_numpy()), False)
    n = len(words) + 1
    blank = Model(words)

    def train(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_order", "ascending")])
        texts = pa.concat_arrays(table.column("_text").cast(pa.large_string()).chunks)
        distinct, number, begins = features(texts)
        columns = blank.known(distinct)[number]
        label = np.repeat(table.column("_toxic").to_numpy(), np.diff(begins)) == 1
        if not len(columns):
            return pa.table({"_theta": pa.array([], pa.binary())})
        theta = fit_field(columns, windows(begins), label & toxic[columns], n)
        return pa.table({"_theta": pa.array([theta.astype("<f8").tobytes()], pa.binary())})

    fitted = fitting.groupBy("_shard").applyInArrow(train, "_theta BINARY").collect()
    if not fitted:
        return Model()
    shards = np.stack([np.frombuffer(r[0], "<f8") for r in fitted])
    # A weight is the mean over the shards that met its word.
    theta = shards.sum(axis=0) / np.maximum(1, (shards != 0).sum(axis=0))
    model = Model(words, theta[: 3 * n].reshape(3, n), float(theta[-5]), theta[-4:].copy())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.aggregated(*model.marginals(batch.column(0)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(1)], ["_most", "_many", "_toxic"]
            )

    # A row per text; where no text is left for it, the curve is fitted to those of the field.
    unseen = sample.where("_fifth = 0")
    for texts in (unseen, sample):
        measured = (
            texts.select("_text", "_toxic")
            .mapInArrow(measure, "_most DOUBLE, _many DOUBLE, _toxic INT")
            .toArrow()
        )
        labels_ = measured.column(2).to_numpy().astype(float)
        if len(set(labels_.tolist())) == 2:
            break
    if not len(labels_):
        return model
    share = [sizes.get(c, 0) / max(1, (labels_ == c).sum()) for c in (0, 1)]
    weight = np.where(labels_ == 1, share[1], share[0])
    x = np.stack([measured.column(0).to_numpy(), measured.column(1).to_numpy()], axis=1)
    curve = fit_curve(x, labels_, weight * len(weight) / weight.sum())
    return Model(model.words, model.weights, model.bias, model.moves, curve)


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    """The stretches of toxic words of a text, as code points from ``start`` to before ``end``, with
    the greatest marginal in them."""
    found: list[dict] = []
    last = -2
    for i, word in enumerate(WORD.finditer(text)):
        if p[i] < 0.5:
            continue
        if last == i - 1:
            found[-1]["end"] = word.end()
            found[-1]["p"] = max(found[-1]["p"], float(p[i]))
        else:
            found.append({"start": word.start(), "end": word.end(), "p": float(p[i])})
        last = i
    return found


def score(documents: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """All columns of ``documents`` (save those called as the new ones) with ``score``, from 0 to 1,
    and ``spans`` (start, end, p), the offending code points of the whole text.

    The text is read and nothing else. NULL and empty texts have no spans and the score of a text
    without toxic words. Repeated rows and equal texts get the same answer; an empty table gives no
    rows. Rows do not move.
    """
    names = ("score", "spans")
    kept = [c for c in documents.columns if c.lower() not in names]
    answers = [
        F.lit(0.0).alias("score"),
        F.lit(None).cast("array<struct<start:bigint,end:bigint,p:double>>").alias("spans"),
    ]
    schema = documents.select(*kept, *answers).schema
    for column in schema:
        column.nullable = True
    shared = documents.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])

    def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(len(kept))
        p, begins = shared.value.marginals(texts)
        spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        likely = np.flatnonzero(p >= 0.5)
        for row in np.unique(np.searchsorted(begins, likely, side="right") - 1):
            spans[row] = spans_of(texts[int(row)].as_py(), p[begins[row] : begins[row + 1]])
        return pa.RecordBatch.from_arrays(
            [
                *batch.columns[: len(kept)],
                pa.array(shared.value.scores(p, begins)),
                pa.array(spans, pa.list_(span)),
            ],
            [*kept, *names],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(len(kept))), 0)
            total = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
            group = total // GROUP_BYTES
            cuts = np.flatnonzero(np.diff(group, prepend=-1, append=np.iinfo(np.int64).max))
            for a, b in zip(cuts, cuts[1:]):
                yield answer(batch.slice(a, b - a))

    read = documents.select(*kept, F.col(text_column).alias(with_free_name(documents, "text_")))
    return read.mapInArrow(run, schema)


def held_out(id_column: Column, of: int = 3, rest: int = 1) -> Column:
    """Rows whose labels are kept from learning, by the CRC-32 of their id as text."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % of == rest, F.lit(False))
