"""The chain against sums over all taggings, its gradient, and accuracy on held-out labels."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import queries, toxic_spans
from tests.llm import brute
from tests.llm.conftest import EDGES, LONG


def weight_of(tags, odds, moves):
    start, enter, leave, stay = moves
    step = {(0, 0): 1.0, (0, 1): enter, (1, 0): leave, (1, 1): stay}
    w = start if tags[0] else 1.0
    for i, tag in enumerate(tags):
        w *= odds[i] if tag else 1.0
        w *= step[tags[i - 1], tag] if i else 1.0
    return w


def test_marginals_are_sums_over_all_taggings():
    rng = np.random.default_rng(1)
    sizes = [3, 0, 1, 7, 5, 0]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    odds, moves = rng.lognormal(size=16), rng.lognormal(size=4)
    ahead, behind = toxic_spans.forward_backward(odds, begins, moves)
    p = ahead * behind / (1 + ahead * behind)
    for a, b in zip(begins, begins[1:]):
        if a == b:
            continue
        total = np.zeros(b - a + 1)
        for tags in itertools.product((0, 1), repeat=b - a):
            w = weight_of(tags, odds[a:b], moves)
            total += w * np.array([*tags, 1])
        assert np.allclose(p[a:b], total[:-1] / total[-1])


def likelihood(theta, columns, begins, y, n):
    weights, bias = theta[: 3 * n].reshape(3, n), theta[-5]
    odds = np.exp(toxic_spans.emissions(columns, begins, weights, bias))
    moves, total = np.exp(theta[-4:]), 0.0
    for a, b in zip(begins, begins[1:]):
        ways = [weight_of(t, odds[a:b], moves) for t in itertools.product((0, 1), repeat=b - a)]
        total += np.log(weight_of(tuple(y[a:b]), odds[a:b], moves)) - np.log(sum(ways))
    return total


def test_fit_climbs_the_likelihood():
    """Where the fit stops, no single weight can raise the penalised likelihood by much."""
    rng = np.random.default_rng(3)
    begins = np.array([0, 4, 5, 11, 14, 20])
    columns, n = rng.integers(0, 4, 20), 4
    y = ((columns == 2) | (rng.random(20) < 0.2)).astype(int)
    theta = toxic_spans.fit_field(columns, begins, y == 1, n)
    blank = np.zeros_like(theta)
    best = likelihood(theta, columns, begins, y, n)
    assert best > likelihood(blank, columns, begins, y, n) + 3
    for i in range(len(theta)):
        for step in (0.3, -0.3):
            moved = theta.copy()
            moved[i] += step
            assert likelihood(moved, columns, begins, y, n) < best + 0.3


def test_texts_do_not_touch():
    columns, weights = np.array([0, 1, 2, 1]), np.arange(12.0).reshape(3, 4)
    got = toxic_spans.emissions(columns, np.array([0, 2, 2, 4]), weights, 0.5)
    # Own weight, that of the word before and that of the word after.
    assert got.tolist() == [0.5 + 0 + 9, 0.5 + 1 + 4, 0.5 + 2 + 9, 0.5 + 1 + 6]


def test_toxic_words():
    toxic = np.array([40, 1, 500, 6, 0])
    clean = np.array([0, 3, 9000, 60, 400])
    assert toxic_spans.toxic_words(toxic, clean).tolist() == [True, False, False, False, False]
    assert not toxic_spans.toxic_words(np.zeros(3), np.zeros(3)).any()
    assert not toxic_spans.toxic_words(np.ones(3), np.zeros(3)).any()


def planted(spark, n=600):
    rng = random.Random(8)
    plain = ["".join(p) for p in itertools.product("bdfglmnrst", "aeiou", "kmpv")]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(5, 60))
        toxic = int(rng.random() < 0.3)
        for _ in range(toxic * rng.randint(1, 3)):
            words.insert(rng.randrange(len(words)), rng.choice(["Zounds!", "vile,", "*foul*"]))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic, i % 2))
    return (
        spark.createDataFrame(rows, "doc_id BIGINT, text STRING"),
        spark.createDataFrame(labels, "doc_id BIGINT, toxic INT, score INT"),
        rows,
        {i: t for i, t, _ in labels},
    )


def test_spans_of_planted_words(spark):
    documents, labels, rows, truth = planted(spark)
    model = toxic_spans.fit(documents.where("doc_id % 3 != 1"), labels)
    got = {r.doc_id: r for r in toxic_spans.score(documents, model).collect()}
    found = want = 0
    for i, text in rows:
        assert (got[i].score >= 0.7) == bool(truth[i])
        toxic = {"Zounds!", "vile,", "*foul*"}
        spans = " ".join(text[s.start : s.end] for s in got[i].spans).split()
        assert set(spans) <= toxic
        found, want = found + len(spans), want + sum(w in toxic for w in text.split())
    # Two toxic words in a row are rare here, and some second ones are not found.
    assert found >= 0.97 * want


def test_held_out_labels(spark, directory):
    rows = queries.QUERIES["op13_toxic_spans"](spark, directory.replace("sf0.001", "sf0.01")).collect()
    path = directory.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert all(r.held_out == brute.held_out(r.doc_id, 3, 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    toxic = [r for r in held if truth[r.doc_id]]
    clean = [r for r in held if not truth[r.doc_id]]
    # Some labelled toxic documents hold none of the words that mark the others.
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_edges(spark, edges, nothing):
    labels = spark.createDataFrame(
        [(1, 0), (4, 1), (5, 0), (5, 1), (6, None), (None, 1), (7, 3), (8, 0)],
        "doc_id BIGINT, toxic INT",
    )
    model = toxic_spans.fit(edges, labels)
    out = toxic_spans.score(edges, model)
    assert len(out.collect()) == len(EDGES)
    assert set(out.columns) == {c for c in edges.columns if c != "SCORE"} | {"score", "spans"}
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert toxic_spans.score(nothing, model).collect() == []
    none = toxic_spans.fit(nothing, labels)
    assert {r.score for r in toxic_spans.score(edges, none).collect()} == {0.0}
    assert {r.score for r in toxic_spans.score(edges, toxic_spans.fit(edges, labels.limit(0))).collect()} == {0.0}


@pytest.mark.parametrize("size", [1, 7, 5000])
def test_long_texts_are_read_whole(size):
    model = toxic_spans.Model(
        pa.array(["vile"], pa.large_string()), np.array([[9.0, 0], [0, 0], [0, 0]]), -4.0, curve=np.array([0, 1.0, 0])
    )
    texts = pa.array([LONG * 2 + "vile!" + " x" * size, None, "", " VILE "])
    p, begins = model.marginals(texts)
    assert np.flatnonzero(p > 0.5).tolist() == [56000, 56001 + size]
    assert toxic_spans.spans_of(texts[0].as_py(), p[: begins[1]])[0]["start"] == 2 * len(LONG)
    assert (model.scores(p, begins) > 0.7).tolist() == [True, False, False, True]
