"""NULLs, empty and long texts, repeated rows, empty tables and clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import (
    chat,
    html_text,
    language_id,
    line_dedup,
    mixing,
    pieces,
    quality,
    simhash,
    suffix_tree,
    vector_dedup,
)
from tablewright.llm.common import n_words
from tablewright.llm.queries import piece_model
from tests.llm.conftest import EDGES, LONG

APPLY = {
    "suffix_tree": suffix_tree.score_texts,
    "simhash": simhash.near_duplicates,
    "mixing": lambda d: mixing.mix(d, n_words(F.col("text"))).taken(),
    "language_id": lambda d: language_id.identify(d, language_id.fit(d)),
    "quality": quality.quality,
    "pieces": lambda d: pieces.encode(d, piece_model()),
    "line_dedup": lambda d: line_dedup.drop_shared_lines(d, min_documents=2, carry=d.columns),
}


@pytest.mark.parametrize("name", APPLY)
def test_one_row_for_each_row(spark, edges, name):
    assert len(APPLY[name](edges).collect()) == len(EDGES)


@pytest.mark.parametrize("name", APPLY)
def test_empty_table(spark, nothing, name):
    assert APPLY[name](nothing).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_edges_and_empty_tables(spark, edges, nothing, name, stage):
    for docs in (edges, nothing):
        out = stage(spark, docs, "")
        if name != "pieces":
            assert out.columns == docs.columns
        assert len(out.collect()) <= 2 * docs.count()


def test_texts_of_the_edge_cases(spark, edges):
    lines = {r._id: r for r in APPLY["line_dedup"](edges).collect()}
    assert (lines[1].n_lines, lines[1].n_dropped, lines[1].kept_text) == (1, 0, "")
    assert lines[4].kept_text == LONG and lines[4].n_lines == 4001
    # Ids 5 and 6 share both lines; the row that repeats id 5 is no further document.
    assert (lines[5].n_dropped, lines[5].kept_text) == (2, "")
    near = {r._id: r for r in APPLY["simhash"](edges).collect()}
    assert near[1]._fp == near[2]._fp == near[3]._fp == 0
    assert [near[i].component_id for i in (1, 2, 3, 5, 6)] == [1, 1, 1, 5, 5]
    assert near[None].component_id is None
    named = {r.doc_id: r for r in APPLY["language_id"](edges).collect()}
    assert [named[i].lang_pred for i in (1, 2, 3, 7)] == ["und"] * 4
    assert named[1].score == 0 and 0 < named[4].score <= 1
    judged = {r._id: r for r in APPLY["quality"](edges).collect()}
    assert (judged[1].n_words, judged[1].kept, judged[1].clean_text) == (0, False, "")
    assert judged[4].n_words == 28000 and judged[4].n_repeat_words == 28000
    assert judged[4].n_dup_lines == 3999 and judged[4].base_failed


def test_conversations(spark):
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, _id INT, segments INT"
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, None, None, None), (2, None, None, None),
        (None, 0, "user", ""), (3, 0, "system", LONG),
    ]
    turns = spark.createDataFrame([(*r, 0, 0) for r in rows], schema)
    got = {r._id: r for r in chat.format_chats(turns).collect()}
    assert {i: (r.n_turns, r.valid) for i, r in got.items()} == {
        1: (2, True), 2: (2, False), None: (1, False), 3: (1, False)
    }
    assert got[1].formatted == (
        "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
    )
    assert chat.format_chats(turns.limit(0)).collect() == []


def test_pages(spark):
    schema = "page_id BIGINT, url STRING, html STRING, text INT"
    rows = [(1, None, None, 1), (2, "u", "", 1), (3, "u", "plain &amp; simple", 1), (3, "u", "<p>", 1)]
    pages = spark.createDataFrame(rows, schema)
    got = html_text.extract(pages)
    assert sorted(r.text for r in got.collect()) == ["", "", "", "plain & simple"]
    assert html_text.extract(pages.limit(0)).collect() == []


def test_vectors(spark):
    schema = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, _vec INT, _node INT"
    rows = [
        (1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (2, [0.0, 1.0], 0), (3, [0.0, 2.0], 0),
        (4, None, 0), (5, [0.0, 0.0], 0), (6, [float("nan"), 1.0], 0), (7, [], 0),
        (8, [1.0, None], 0), (9, [1.0, 0.0], None), (None, [1.0, 0.0], 0), (10, [1.0], 0),
        (11, [1.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [float("inf"), 0.0], 0),
    ]
    vectors = spark.createDataFrame([(*r, 0, 0) for r in rows], schema)
    got = sorted(map(tuple, vector_dedup.near_vectors(vectors).collect()), key=repr)
    # The id 2 stands for two vectors and so connects 1 with 3.
    want = [
        (1, 1, 1), (2, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7),
        (8, 0, 8), (9, 0, 9), (None, 0, None), (10, 0, 10), (11, 1, 11), (11, 1, 11), (12, 0, 12),
    ]
    assert got == sorted(want, key=repr)
    assert vector_dedup.near_vectors(vectors.limit(0)).collect() == []
