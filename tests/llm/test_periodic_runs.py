"""Periodic runs against brute force over every start and period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tablewright.llm import periodic_runs, queries
from tests.llm import brute
from tests.llm.conftest import EDGES


def runs_of(words, least=6, exponent=4):
    """Maximal stretches for every period, less those of a smaller period."""
    found = {}
    n = len(words)
    for period in range(1, n // exponent + 1):
        i = 0
        while i + period < n:
            j = i
            while j + period < n and words[j] == words[j + period]:
                j += 1
            length = j + period - i
            if j > i and length >= max(least, exponent * period):
                found.setdefault((i, length), period)
            i = max(j, i + 1)
    return sorted((start, length, period) for (start, length), period in found.items())


def collapse(words, runs):
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    return [w for i, w in enumerate(words) if i not in dropped]


def shape(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return rng.choices("ab", k=rng.randint(0, 60))
    if kind == 1:
        return rng.choices("abc", k=rng.randint(0, 9)) * rng.randint(0, 9) + rng.choices("abc", k=4)
    if kind == 2:
        unit = rng.choices("abcdefgh", k=rng.randint(1, 30))
        return rng.choices("ab", k=5) + unit * 5 + unit[: rng.randint(0, len(unit))] + ["z"]
    if kind == 3:
        return (["a"] * rng.randint(1, 9) + ["b"]) * rng.randint(1, 9) + ["a"] * rng.randint(0, 9)
    return [str(i) for i in range(rng.randint(0, 20))]


def test_find_runs():
    rng = random.Random(4)
    for _ in range(1500):
        words = shape(rng)
        numbers = np.array([hash(w) % 1000 for w in words], np.int64)
        got = [tuple(map(int, r)) for r in periodic_runs.find_runs(numbers)]
        assert got == runs_of(numbers.tolist()), words


def test_long_periods():
    unit = list(range(5000))
    numbers = np.array(list(range(-9, -2)) + unit * 4 + [0, 1, -1], np.int64)
    assert periodic_runs.find_runs(numbers).tolist() == [[7, 20002, 5000]]
    assert periodic_runs.find_runs(np.zeros(100_000, np.int64)).tolist() == [[0, 100_000, 1]]


def test_exponent_has_a_bound(spark):
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(spark.createDataFrame([("a",)], "text STRING"), least_exponent=3)


def test_texts_in_one_batch_do_not_touch(spark):
    rng = random.Random(9)
    texts = [" ".join(shape(rng)) for _ in range(300)] + ["a a a", "a a a a a a", " a\ta\x0ba a\n\na a ", "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING").coalesce(1)
    for r in periodic_runs.periodic_runs(frame).collect():
        words = brute.WORD.findall(texts[r.id] or "")
        want = runs_of(words)
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == want
        assert r.collapsed_text == " ".join(collapse(words, want))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark, directory):
    documents = spark.read.parquet(f"{directory}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op12_periodic_runs"](spark, directory).collect()}
    assert len(got) == len(documents)
    planted = 0
    for d in documents:
        words = brute.WORD.findall(d.text or "")
        h = zlib.crc32(str(d.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        runs = runs_of(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        milli = best[1] and 1000 * best[1] // best[2]
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, milli)
        assert r.runs_sha256 == digest("".join(f"{s},{m},{p}\n" for s, m, p in runs))
        assert r.collapsed_sha256 == digest(" ".join(collapse(words, runs)))
    assert planted > 5


def test_edges(spark, edges, nothing):
    out = periodic_runs.periodic_runs(edges)
    rows = out.collect()
    assert len(rows) == len(EDGES) and set(edges.columns) < set(out.columns)
    assert periodic_runs.periodic_runs(nothing).collect() == []
    assert {r.collapsed_text for r in rows if r.doc_id in (1, 2, 3)} == {""}
    long = next(r for r in rows if r.doc_id == 4)
    # Lines of seven words: the line end is no word, so the whole text is one run.
    assert [tuple(x) for x in long.runs] == [(0, 28000, 7)] and len(long.collapsed_text.split()) == 7
    clash = edges.selectExpr("text", "doc_id", "size AS runs", "size AS N_WORDS", "_text AS collapsed_text")
    assert periodic_runs.periodic_runs(clash).columns == ["text", "doc_id", "n_words", "runs", "collapsed_text"]
