"""Each stage of the pipeline against a plain version, on its own input."""

import collections
import re

import corpus_pipeline
from tablewright.llm.queries import piece_model
from tests.llm import brute

STAGES = dict(corpus_pipeline.STAGES)


def test_stages(spark, directory):
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    before = docs.collect()

    named = STAGES["language_id"](spark, docs, directory)
    kept = {r.doc_id for r in named.collect()}
    assert kept == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}

    lines = STAGES["line_dedup"](spark, docs, directory).collect()
    found = collections.defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(brute.LOWER)
    for r in before:
        for line in r.text.split("\n"):
            found[key(line)].add(r.doc_id)
    want = {
        r.doc_id: "\n".join(x for x in r.text.split("\n") if not key(x) or len(found[key(x)]) < 10)
        for r in before
    }
    assert {r.doc_id: r.text for r in lines} == want
    assert all(r.n_chars == len(r.text) for r in lines)

    single = STAGES["simhash"](spark, docs, directory).collect()
    groups = brute.simhash_components([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in single) == sorted(set(groups.values()))
    assert {tuple(r) for r in single} <= {tuple(r) for r in before}

    mixed = collections.Counter(r.doc_id for r in STAGES["mixing"](spark, docs, directory).collect())
    from pyspark.sql import functions as F

    from tablewright.llm import mixing
    from tablewright.llm.common import n_words

    taken = mixing.mix(docs, n_words(F.col("text"))).taken().where("taken > 0").collect()
    assert mixed == {r._id: -(-r.taken // r.size) for r in taken}

    encoded = STAGES["pieces"](spark, docs, directory).collect()
    assert len(encoded) == len(before) and all(r.round_trip for r in encoded)


def test_run(spark, directory):
    out = corpus_pipeline.run(spark, directory).collect()
    assert out and all(r.round_trip and r.n_pieces == len(r.ids) for r in out)


CLASHES = (
    "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, _score STRING, "
    "_language STRING, score STRING, lang_pred STRING, language_ STRING, facts MAP<STRING, INT>"
)


def clashing(spark, rows):
    full = [(i, t, "en", "s", len(t or ""), "a", "b", "c", "d", "e", {"k": 1}) for i, t in rows]
    return spark.createDataFrame(full, CLASHES)


LONG_TEXT = "the same words of a text that is long enough to be told from the others "


def test_columns_of_the_user_stay(spark):
    docs = clashing(spark, [(1, LONG_TEXT * 3), (2, "und dieser ist ein ganz anderer Text"), (3, None)])
    for name in ("language_id", "line_dedup", "simhash", "mixing"):
        out = STAGES[name](spark, docs, "")
        assert out.columns == docs.columns
        for r in out.collect():
            assert (r._score, r._language, r.score, r.lang_pred, r.language_) == ("a", "b", "c", "d", "e")
            assert r.facts == {"k": 1}


def test_repeated_ids_keep_unlike_texts(spark):
    other = "quite different sentences stand here and share nothing with what stands above "
    rows = [(1, LONG_TEXT), (1, other), (None, LONG_TEXT), (None, other * 2), (None, other * 2), (7, other)]
    rows += [(8, None), (9, ""), (None, " ")]
    kept = STAGES["simhash"](spark, clashing(spark, rows), "").collect()
    got = sorted(((r.doc_id, r.text) for r in kept), key=repr)
    assert got == sorted([(1, LONG_TEXT), (1, other), (None, other * 2), (8, None)], key=repr)


def test_rows_without_an_id(spark):
    """They are no hot key of any stage: each is a text like others."""
    docs = spark.range(20000).selectExpr(
        "CAST(NULL AS BIGINT) AS doc_id", "concat('a text with the number ', id) AS text",
        "'en' AS lang", "'s' AS source", "20L AS n_chars",
    )
    encoded = STAGES["pieces"](spark, docs.repartition(6), "")
    assert encoded.where("round_trip AND doc_id IS NULL").count() == 20000
    assert encoded.groupBy("ids").count().count() == 20000


def best_path(word, known, least):
    """The highest sum of scores of a word and its pieces, by every cut; of equal sums the longest
    last piece."""
    found = {0: (0.0, [])}
    for end in range(1, len(word) + 1):
        for start in range(end):
            piece = word[start:end]
            if piece in known or len(piece) == 1:
                score = found[start][0] + known.get(piece, least)
                if end not in found or score > found[end][0]:
                    found[end] = (score, found[start][1] + [piece])
    return found[len(word)][1]


def test_pieces_stage_takes_the_best_path(spark):
    """Viterbi over the lattice, with bytes for what is no piece, and words of any length."""
    model = piece_model()
    known = {text: score for text, score, _ in model.table}
    number = {text: i for text, _, i in model.table}
    least = min(known.values()) - 10
    texts = ["unbelievable transformations of tokenizers", "a  b", "x" * 90 + " internationalization"]
    texts += ["na\u00efve \u4e16\u754c \U0001f600\U00012345", "line one\nline two", "", None, "\n", " "]
    docs = clashing(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in STAGES["pieces"](spark, docs, "").collect()}
    for i, text in enumerate(texts):
        # The words do not share pieces: a line end is a word, and marks begin one.
        words = re.findall("\n|\u2581+[^\u2581\n]*|[^\u2581\n]+", "\u2581" + text.replace(" ", "\u2581")) if text else []
        want = []
        for piece in (p for w in words for p in best_path(w, known, least)):
            want += [number[piece]] if piece in number else [model.byte_ids[o] for o in piece.encode()]
        assert got[i].path_ids == want and got[i].round_trip
    assert any(r.path_ids != r.ids for r in got.values())
