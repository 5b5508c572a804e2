"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams of one to three code points, weighted by TF-IDF. Document
frequencies are counted over all training texts. The regression is trained with follow the
regularised leader, per coordinate and with an elastic net, so n-grams that tell nothing get weight
zero; its probabilities are then calibrated with one temperature.

The regression is fitted on a sample of about ``PER_LANGUAGE`` texts for each language, drawn by a
hash of their ids, in ``SHARDS`` shards whose weights are averaged. The sample, the table of weights
(``SIZE`` by languages) and the document frequencies have bounds that do not grow with the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.common import stage, with_free_name

SIZE = 1 << 16  # hashed n-grams
PER_LANGUAGE = 2000  # texts, about, of each language to fit on; a fifth of them calibrates
SHARDS = 4
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-5
CHUNK = 1 << 20  # code points that are hashed at once
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
SHIFT = np.uint32(32 - 16)


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram stands in a text, in lower case between two blanks."""
    found = np.zeros(SIZE, np.int64)
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    with np.errstate(over="ignore"):
        for start in range(0, len(points), CHUNK):
            # Chunks overlap by two, so that every n-gram is counted once.
            one = points[start : start + CHUNK + 2]
            two = one[:-1] * np.uint32(2654435761) + one[1:]
            three = two[:-1] * np.uint32(2246822519) + one[2:]
            for gram, mix in ((one, 3266489917), (two, 668265263), (three, 374761393)):
                gram = gram[: min(len(gram), CHUNK)]
                hashed = gram * np.uint32(mix)
                hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(2246822519)
                found += np.bincount(hashed >> SHIFT, minlength=SIZE)
    return found


def has_letter(text: str | None) -> bool:
    return text is not None and LETTER.search(text) is not None


@dataclass(frozen=True)
class Model:
    """``weights`` has a row per n-gram and a column per language."""

    languages: tuple[str, ...] = ()
    idf: np.ndarray = field(default_factory=lambda: np.zeros(SIZE))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((SIZE, 0)))
    temperature: float = 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = counts(text)
        at = np.flatnonzero(found)
        values = np.log1p(found[at]) * self.idf[at]
        norm = np.sqrt(values @ values)
        return at, values / norm if norm else values

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and probability; ``und`` and 0 for NULL, for texts without letters and where
        nothing was learned."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        at, values = self.features(text)
        p = softmax((values @ self.weights[at]) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def fit_ftrl(examples: list, n_languages: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from ``(at, values, label)`` in turn, by FTRL-Proximal with an elastic net."""
    z = np.zeros((SIZE, n_languages))
    n = np.zeros((SIZE, n_languages))

    def closed_form(z, n):
        shrunk = np.sign(z) * L1 - z
        return np.where(np.abs(z) <= L1, 0.0, shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for epoch in range(epochs):
        for at, values, label in examples:
            w = closed_form(z[at], n[at])
            p = softmax(values @ w)
            p[label] -= 1
            gradient = values[:, None] * p
            squares = gradient * gradient
            z[at] += gradient - (np.sqrt(n[at] + squares) - np.sqrt(n[at])) / ALPHA * w
            n[at] += squares
    return closed_form(z, n)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss on held-out rows, on a grid between 1/64 and 8."""
    if not len(labels):
        return 1.0
    grid = 2.0 ** np.arange(-6, 3.01, 0.125)
    rows = np.arange(len(labels))
    loss = [-np.log(softmax(logits / t)[rows, labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, texts = np.zeros(SIZE, np.int64), 0
    for batch in batches:
        for value in batch.column(0):
            text = value.as_py()
            if has_letter(text):
                found += counts(text) > 0
                texts += 1
    if texts:
        at = np.flatnonzero(found)
        # The number of texts goes along as n-gram -1.
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1)), pa.array(np.append(found[at], texts))],
            ["_gram", "_texts"],
        )


def fit(
    training: DataFrame,
    per_language: int = PER_LANGUAGE,
    shards: int = SHARDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "lang",
) -> Model:
    """A model from the rows of ``training`` that have a text with a letter and a label.

    Without such rows the model answers ``und`` to everything. Labels are few (a language each).
    """
    rows = training.select(
        F.col(id_column).alias("_id"),
        F.col(text_column).alias("_text"),
        F.col(label_column).alias("_label"),
    ).where("_text IS NOT NULL AND _label IS NOT NULL")
    grams = (
        rows.select("_text")
        .mapInArrow(_document_frequencies, "_gram BIGINT, _texts BIGINT")
        .groupBy("_gram")
        .agg(F.sum("_texts").alias("_texts"))
        .toArrow()  # at most SIZE + 1 rows
    )
    at, found = grams.column(0).to_numpy(), grams.column(1).to_numpy()
    if not len(at):
        return Model()
    frequencies = np.zeros(SIZE)
    frequencies[at[at >= 0]] = found[at >= 0]
    idf = np.log((1 + found[at < 0][0]) / (1 + frequencies)) + 1
    sizes = {r[0]: r[1] for r in rows.groupBy("_label").agg(F.count(F.lit(1))).collect()}
    languages = tuple(sorted(sizes))
    unit = 1 << 32
    draw = F.pmod(F.xxhash64(F.lit("sample"), "_id"), F.lit(unit))
    share = F.create_map(
        *(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(unit, unit * per_language // n))))
    )
    sample = stage(
        rows.where(draw < share[F.col("_label")]).select(
            "_text",
            "_label",
            F.pmod(F.xxhash64(F.lit("shard"), "_id"), F.lit(5)).alias("_fifth"),
            F.pmod(F.xxhash64(F.lit("part"), "_id"), F.lit(shards)).alias("_shard"),
            F.xxhash64(F.lit("order"), "_id").alias("_order"),
        ),
        "language-sample",
    )
    blank, number = Model(idf=idf), {name: i for i, name in enumerate(languages)}

    def examples(table: pa.Table) -> list:
        made = [
            (*blank.features(text), number[label])
            for text, label in zip(
                table.column("_text").to_pylist(), table.column("_label").to_pylist()
            )
            if has_letter(text)
        ]
        return made

    def train(table: pa.Table) -> pa.Table:
        weights = fit_ftrl(examples(table.sort_by([("_order", "ascending")])), len(languages))
        return pa.table({"_weights": pa.array([weights.astype("<f8").tobytes()], pa.binary())})

    # One table of weights from each shard.
    fitted = (
        sample.where("_fifth != 0").groupBy("_shard").applyInArrow(train, "_weights BINARY").collect()
    )
    if not fitted:
        # Too few rows for a held-out part: fit on all of them.
        fitted = sample.groupBy("_shard").applyInArrow(train, "_weights BINARY").collect()
    weights = sum(
        np.frombuffer(row[0], "<f8").reshape(SIZE, len(languages)) for row in fitted
    ) / max(1, len(fitted))
    broadcast = sample.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = examples(pa.Table.from_batches([batch]))
            logits = [(values @ broadcast.value[at]).tolist() for at, values, _ in made]
            yield pa.RecordBatch.from_arrays(
                [pa.array(logits, pa.list_(pa.float64())), pa.array([m[2] for m in made], pa.int64())],
                ["_logits", "_label"],
            )

    held = (
        sample.where("_fifth = 0")
        .mapInArrow(score, "_logits ARRAY<DOUBLE>, _label BIGINT")
        .toArrow()  # a row per calibration text, a fifth of the sample
    )
    temperature = fit_temperature(
        np.array(held.column(0).to_pylist()).reshape(held.num_rows, len(languages)),
        held.column(1).to_numpy(),
    )
    return Model(languages, idf, weights, temperature)


def identify(
    documents: DataFrame,
    model: Model,
    text_column: str = "text",
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """All columns of ``documents`` (save those called as in ``names``) and, under ``names``, the
    language of each text and its calibrated probability.

    The whole text is read and nothing else. NULL text and text without a letter are ``und`` with
    score 0. Rows do not move; repeated rows get the same answer.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in documents.columns if c.lower() not in names]
    answers = [F.lit("").alias(names[0]), F.lit(0.0).alias(names[1])]
    schema = documents.select(*kept, *answers).schema
    for column in schema:
        column.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shared.value.predict(t.as_py()) for t in batch.column(len(kept))]
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([m[0] for m in made], pa.string()),
                 pa.array([m[1] for m in made], pa.float64())],
                [*kept, *names],
            )

    read = documents.select(*kept, F.col(text_column).alias(with_free_name(documents, "text_")))
    return read.mapInArrow(run, schema)


def held_out(id_column: Column, of: int = 4, rest: int = 2) -> Column:
    """Rows that are kept from training, by the CRC-32 of their id as text."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % of == rest, F.lit(False))
