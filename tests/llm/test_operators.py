"""Operators against plain versions, against SQL, and by what they must leave unchanged."""

import gc
import random
import weakref

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import (
    blocks,
    chat,
    html_text,
    language_id,
    mixing,
    pieces,
    queries,
    simhash,
    suffix_tree,
    vector_dedup,
)
from tablewright.llm.common import components, n_words
from tests.llm import brute
from tests.llm.conftest import table
from tests.oracle import check, connect


@pytest.fixture(scope="module")
def duck(directory):
    return connect(directory)


@pytest.fixture(scope="module")
def documents(spark, directory):
    return spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "text", "lang").collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, directory, name):
    check(queries.QUERIES[name](spark, directory), duck, queries.ORACLES[name])


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (5, 300), (300, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "u BIGINT, v BIGINT")).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, 300: 1, 100: 100, 101: 100}


@pytest.mark.parametrize(
    "depth,min_count,min_divergence,by_condition",
    [
        (2, 2, 0.02, True),
        (4, 20, 0.02, False),
        (5, 1, 1e-3, True),
        (1, 5, 0.01, True),
        (0, 1, 0.0, True),
        (4, 10**6, 0.0, False),
    ],
)
def test_suffix_tree(spark, depth, min_count, min_divergence, by_condition):
    rng = random.Random(3)
    vocabulary = ["the", "of", "cat", "sat", "on", "A", "mat.", "rare", "é"]
    texts = [" ".join(rng.choices(vocabulary, [9, 7, 3, 3, 3, 2, 2, 0.2, 1], k=rng.randint(0, 40))) for _ in range(300)]
    texts += ["the cat sat on the mat."] * 60
    docs = table(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    learns = F.col("doc_id") % 5 != 1
    training = learns if by_condition else docs.where(learns)
    want, kept = brute.tree_scores(
        [t for i, t in enumerate(texts) if i % 5 != 1], texts, depth, min_count, min_divergence
    )
    got = suffix_tree.score_texts(docs, training, depth, min_count, min_divergence).collect()
    scores = {r._id: r.score for r in got}
    assert len(got) == len(texts)
    assert np.allclose([scores[i] for i in range(len(texts))], want, rtol=1e-9)
    if 0 < depth and min_count < 10**6:
        assert max(map(len, kept)) == depth
        assert any(r.n_in_states for r in got)
    else:
        assert kept == {()}


def test_suffix_tree_grows_with_the_corpus(spark):
    """Copies of a corpus under other words give as many further states, at the same scores."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randint(0, 5)}" for _ in range(30)) for _ in range(40)]

    def scored(copies):
        docs = table(
            spark,
            [(c * 100 + i, t.replace("w", f"v{c}_"), "en", "s") for c in range(copies) for i, t in enumerate(texts)],
        )
        return suffix_tree.score_texts(docs, depth=3, min_count=8).collect()

    share = [sum(r.n_in_states for r in rows) / sum(r.n_tokens for r in rows) for rows in map(scored, (1, 4))]
    assert abs(share[0] - share[1]) < 0.02 and share[0] > 0.9


def test_suffix_tree_asks_with_hashes_once():
    """A part passes on which of its candidates a block asks for by their places, not by hashes, and
    answers in the order of the questions."""
    rng = np.random.default_rng(3)
    known = np.unique(rng.integers(0, 1 << 63, 6000, dtype=np.uint64))
    asked = [known, known[::2], known[:0]]
    n = len(known)

    def numbers(block, values, kind):
        return suffix_tree.squeeze_numbers(np.full(len(asked[block]), values, kind))

    rows = []
    for block, keys in enumerate(asked):
        mine = n if block == 0 else 0  # this block speaks for all
        spoken = [np.full(mine, 50, "<i8"), np.full(mine, 100, "<i8"), np.zeros(2 * mine, "<u8")]
        gain = np.where(np.arange(len(keys)) % 3 == 0, 1 << 22, -(1 << 24)).astype("<i8")
        whole = [suffix_tree.squeeze_numbers(gain), numbers(block, 1 << 16, "<i8"), numbers(block, block == 0, "<i4")]
        rows.append((0, block, suffix_tree._steps(keys), *whole, *map(suffix_tree.squeeze_numbers, spoken)))
    tested = suffix_tree._test(1, 2, 0.02)(suffix_tree._rows(suffix_tree._SHARED, rows))
    passed = {r["_block"]: r["_keys"] for r in tested.to_pylist() if r["_block"] is not None}
    assert set(passed) == {0, 1, 2} and sum(map(len, passed.values())) < n
    told = {
        r["_block"]: suffix_tree.expand_numbers(r["_states"], "<i8").tolist()
        for r in suffix_tree._tell(tested).to_pylist()
    }
    gain = np.where(np.arange(n) % 3 == 0, 1 << 22, -(1 << 24))
    gain[::2] += np.where(np.arange(len(asked[1])) % 3 == 0, 1 << 22, -(1 << 24))
    kinds = np.where(np.arange(n) % 2, 1, 2)
    passes = gain / 65536 / 50 - np.log(0.5) - (kinds - 1) / 100 >= 0.02
    want = np.where(passes, kinds, 0)
    assert 0 < passes.sum() < n
    assert told == {0: want.tolist(), 1: want[::2].tolist(), 2: []}


def test_suffix_tree_frees_a_block_with_its_last_use():
    """A task goes through many blocks, and none of them may wait for Python to look for cycles."""
    rows = pa.table({"_id": [1], "_text": [b"a b a b"], "_use": pa.array([3], pa.int32())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    blob = blocks.squeeze(sink.getvalue().to_pybytes())
    gc.disable()
    try:
        block = suffix_tree._Block(pa.table({"_block": [0], "_blob": [blob]}), 2, 1)
        assert len(block.tokens) == len(block.counts[1]) == len(block.index[1]) == 5
        alive = weakref.ref(block)
        del block
        assert alive() is None
    finally:
        gc.enable()


def test_suffix_tree_beats_single_words(spark, directory):
    rows = queries.QUERIES["op1_suffix_tree_scores"](spark, directory).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_word_hashes_over_pieces():
    text = b" a bb\tccc \x0bdd" + b"w" * (3 << 20) + b" \x85e e"
    starts, hashes = suffix_tree.Hasher().words(text)
    assert [text[s : s + 2] for s in starts] == [b"a ", b"bb", b"cc", b"dd", b"\x85e", b"e"]
    assert len(set(hashes.tolist())) == 6
    alone = [suffix_tree.Hasher().words(w)[1][0] for w in text.split()]
    assert alone == hashes.tolist()


def test_simhash(spark, directory, documents):
    got = queries.QUERIES["op2_simhash"](spark, directory).collect()
    want = brute.simhash_components([(d.doc_id, d.text) for d in documents])
    assert {r.doc_id: r.component_id for r in got} == want
    texts = {d.doc_id: d.text for d in documents}
    assert all(r.fingerprint == f"{brute.fingerprint(texts[r.doc_id]):016x}" for r in got)


@pytest.mark.parametrize("bucket", [1, 3, 64])
def test_simhash_links_in_crowded_buckets(spark, bucket):
    rng = random.Random(5)
    middles = [rng.getrandbits(64) for _ in range(6)]
    marks = sorted(
        {m ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for m in middles for _ in range(60)}
    )
    signed = [(i, m - (1 << 64) if m >> 63 else m) for i, m in enumerate(marks)]
    classes = spark.createDataFrame(signed, "_node BIGINT, _fp BIGINT")
    found = dict(map(tuple, components(simhash._links(classes, bucket)).collect()))
    groups = brute.Groups()
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            if (a ^ b).bit_count() <= 2:
                groups.join(i, j)
    assert [found.get(i, i) for i in range(len(marks))] == [groups.root(i) for i in range(len(marks))]


def test_mixing_schedule(spark, directory):
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    mixed = mixing.mix(docs, n_words(F.col("text")), slots=2000)
    rows = mixed.taken().collect()
    by_source = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken, target = by_source.get(r._rank, (0, r.target))
        by_source[r._rank] = (taken + r.taken, target)
    assert all(abs(taken - target) <= 1 for taken, target in by_source.values())
    slots = mixed.pieces.groupBy("slot", "_rank", "block").agg(F.sum("n_words").alias("n")).orderBy("slot").collect()
    block = max(s.n for s in slots)
    # All but the last block of a source are equal, and each source's blocks come in order.
    last = {}
    for s in slots:
        assert last.get(s._rank, -1) + 1 == s.block
        last[s._rank] = s.block
    assert sum(s.n != block for s in slots) <= len(last)
    # Every stretch of the schedule holds the sources in proportion.
    total = sum(target for _, target in by_source.values())
    half = slots[: len(slots) // 2]
    for rank, (_, target) in by_source.items():
        assert abs(sum(s._rank == rank for s in half) - len(half) * target / total) < 8


def test_mixing_small_tables(spark):
    docs = table(spark, [(1, "a b c", None, "x"), (2, "d", None, None), (3, None, None, "y")])
    got = {r._id: (r.size, r.source_size, r.target, r.taken) for r in mixing.mix(docs, n_words(F.col("text"))).taken().collect()}
    # Targets of 6: x weighs 5 and y, without words, stops at 0; the rest goes by weight 5 and 1.
    assert got == {1: (3, 3, 5.0, 5), 2: (1, 1, 1.0, 1), 3: (0, 0, 0.0, 0)}


def test_language_id(spark, directory, documents):
    rows = queries.QUERIES["op4_language_id"](spark, directory).collect()
    truth = {d.doc_id: d.lang for d in documents}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(r.held_out == brute.held_out(r.doc_id, 4, 2) for r in rows)


def test_language_counts_over_chunks(monkeypatch):
    text = "Ünïcode text, counted whole. " * 50
    whole = language_id.counts(text)
    monkeypatch.setattr(language_id, "CHUNK", 64)
    assert (language_id.counts(text) == whole).all()
    n = len(text) + 2
    assert whole.sum() == n + (n - 1) + (n - 2)


def test_elastic_net_and_temperature():
    examples = [(np.array([0, i % 2 + 1]), np.array([1.0, 1.0]), i % 2) for i in range(200)]
    weights = language_id.fit_ftrl(examples, 2)
    assert weights[1, 0] > 0 > weights[1, 1] and (weights[3:] == 0).all()
    logits = np.array([[4.0, 0.0]] * 10)
    labels = np.array([0] * 7 + [1] * 3)
    p = language_id.softmax(logits / language_id.fit_temperature(logits, labels))
    assert abs(p[0, 0] - 0.7) < 0.02


PAGE = """<html><head><title>T</title><style>x</style></head><body class="page sidebar"><header>H</header>
<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p>First   para\ngraph with <b>bold</b> and <a href=3>a link</a>.<p>Short.
<div class="ad">Buy</div><aside>Beside</aside><form><input><button>Go</button></form>
<ul><li>Item&nbsp;one<li>Item two</ul><script>if (a < b) "</p>"</script><table><tr><td>Cell</table>
<section id="comments"><p>Nice post, a rather long comment of a reader that goes on.</p></section></article>
<div id="sidebar">Side text</div><footer>Foot &copy;</footer></body>"""


def test_html():
    assert html_text.main_text(PAGE).split("\n") == [
        "Head & line", "First para graph with bold and a link.", "Short.", "Item one", "Item two", "Cell",
    ]
    plain = "<body><div><a href=1>Home</a> <a href=2>News</a></div><div>" + "<p>A long sentence of real text.</p>" * 9 + "<p>End.</p></div>"
    assert html_text.main_text(plain).split("\n") == ["A long sentence of real text."] * 9 + ["End."]
    assert html_text.main_text("&lt;b&gt; &#233; &eacute; &unknown; & x") == "<b> é é &unknown; & x"


def test_chat_escapes(spark):
    texts = ["", "\\", "\\\\", "<|", "<\\|", "<<||", "\n", "\\n", "a\\\nb", "<|im_end|>\n<|im_start|>user\n", "\\|<|\\"]
    rows = [(i, t, role, x) for i, role in enumerate(texts) for t, x in enumerate(texts)]
    turns = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    template = chat.Template(learned=tuple(texts[:3]))
    chats = chat.format_chats(turns, template)
    got = chats.select("_id", chat.read_turns(F.col("formatted"), template).alias("t"), chat.learned_text(F.col("segments")).alias("l")).collect()
    for r in got:
        assert [(t.role, t.text) for t in r.t] == [(texts[r._id], x) for x in texts]
        assert r.l == ("".join(texts) if r._id < 3 else "")


def test_pieces_are_those_of_the_library(spark, directory, documents):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(11)
    texts = [d.text for d in documents]
    texts += ["".join(rng.choices("aeinstrhl  \n▁_.é日", k=rng.randint(0, 90))) for _ in range(400)]
    texts += ["aaaaaaaaaaaaaaaa" * 9, "    ", "the  the   thing", "x" * 5000, "ingtheandtion" * 30]
    docs = table(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    model = queries.piece_model()
    got = {r._id: r for r in pieces.encode(docs, model).collect()}
    merger = pieces.Merger(model)
    for i, t in enumerate(texts):
        assert got[i].ids == library.encode(t)
        assert got[i].decoded == t.replace("▁", " ") == merger.decode(got[i].ids)


def test_most_words_are_decided_by_the_fold(spark):
    words = ["▁the", "▁thing", "▁nation", "▁unbelievable", "▁straight", "tion", "▁" * 9, "日"]
    table_, longest = pieces.piece_table(spark, queries.piece_model())
    frame = spark.createDataFrame([(0, w) for w in words], "_block INT, _word STRING")
    found = pieces.encoded_words(frame, table_, longest, ["_block"]).collect()
    assert sum(r._pieces is not None for r in found) >= 6


def test_groups_of_texts_are_encoded_alike(spark, documents, monkeypatch):
    """However texts come together, each has the ids that it has alone."""
    import pyarrow as pa

    lattice = pieces.Lattice(queries.piece_model())
    texts = [d.text for d in documents[:60]] + ["", None, " ", "\n", "a\n\n b", "x" * 200, "é" * 90, "日本 " * 9]

    def ids(group):
        words, _ = pieces.words_of(pa.array(group, pa.string()))
        coded = words.dictionary_encode()
        made, begins = lattice.encode(coded.dictionary)
        return [made[begins[i] : begins[i + 1]].tolist() for i in coded.indices.to_pylist()]

    together = ids(texts)
    alone = [word for text in texts for word in ids([text])]
    assert together == alone and sum(map(len, alone)) > 1000


def test_viterbi(spark):
    """The best path over a table of the unigram kind, against every way to cut a word."""
    rng = random.Random(6)
    table_ = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -4.1, "aba": -4.6, "bb": -9.0, "cab": -1.0}
    words = ["", "a", "ab", "abab", "aabba", "c", "cab", "acabc", "cabcab", "bbbb", "ababababababab"]
    words += ["".join(rng.choices("abc", [5, 5, 1], k=rng.randint(1, 9))) for _ in range(60)]

    def best(word):
        found = {0: (0.0, [])}
        for end in range(1, len(word) + 1):
            for start in range(end):
                if start in found and word[start:end] in table_:
                    score = found[start][0] + table_[word[start:end]]
                    if end not in found or score > found[end][0] + 1e-12:
                        found[end] = (score, found[start][1] + [word[start:end]])
        return found.get(len(word))

    numbers = {text: i for i, text in enumerate(table_)}
    pieces_ = spark.createDataFrame(
        [(t, s, numbers[t]) for t, s in table_.items()], "_piece STRING, _score DOUBLE, _id INT"
    )
    frame = spark.createDataFrame([(0, w) for w in set(words)], "_block INT, _word STRING")
    got = {r._word: r for r in pieces.viterbi_words(frame, pieces_, ["_block"]).collect()}
    assert set(got) == set(words)
    for word in words:
        want = best(word)
        if want is None:
            assert got[word].ids is None and got[word].score is None
        else:
            assert abs(got[word].score - want[0]) < 1e-9
            assert "".join(list(table_)[i] for i in got[word].ids) == word
            assert abs(sum(table_[list(table_)[i]] for i in got[word].ids) - want[0]) < 1e-9


@pytest.mark.parametrize("passes,window", [(16, 32), (16, 2)])
def test_vectors(spark, passes, window):
    rng = np.random.default_rng(2)
    near = rng.standard_normal(24)
    rows = [(i, (near + 0.1 * rng.standard_normal(24)).tolist(), 0) for i in range(300)]
    for i in range(300, 500, 2):
        v = rng.standard_normal(24)
        noise = 0.09 * rng.standard_normal(24)
        rows += [(i, v.tolist(), i % 3), (i + 1, (v + noise).tolist(), i % 3)]
    rows += [(i + 500, v, lab) for i, v, lab in rows[:50]]
    vectors = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT")
    got = {r._id: (r.n_links, r.component_id) for r in vector_dedup.near_vectors(vectors, passes=passes, window=window).collect()}
    want = brute.vector_links(rows, 0.98)
    links = sum(n for _, n, _ in want)
    assert links > 1000 and sum(n for n, _ in got.values()) >= 0.97 * links
    assert all(got[i][0] <= n for i, n, _ in want)
    assert sum(got[i][1] == c for i, _, c in want) >= 0.97 * len(want)
