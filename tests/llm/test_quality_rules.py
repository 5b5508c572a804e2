"""Lines that the quality rules take out, and planted texts."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.llm import quality, queries

SENTENCE = "A sentence of this text has a good many words in a row and then it comes to its end"
LINES = {
    # Navigation by structure.
    "Home | About us | Contact": True,
    "Home » News » Sport » Football": True,
    "One • Two • Three •": True,
    "| Name | Size |": False,
    "Home | About": False,
    "Click here": True,
    "menu": True,
    "This | that | a much longer item of more than forty characters in all | other": False,
    "First words | second item has five words here | third": False,
    # End marks: long lines only, not list items.
    SENTENCE: True,
    SENTENCE + ".": False,
    SENTENCE + ":": False,
    SENTENCE + ' he said"': False,
    SENTENCE + "।": False,
    SENTENCE + ",": True,
    "A heading without an end mark": False,
    "- " + SENTENCE: False,
    "12. " + SENTENCE: False,
    "  • " + SENTENCE: False,
    # Marks in place of words.
    "Words### are&&& parted$$$ by%%% marks.": True,
    "OH!! NO!! NOT!! AGAIN!!": True,
    "Costs are 5 % up, and so are fees & fines.": False,
    "Really?! Yes!!": False,
    # Boilerplate.
    "All rights reserved.": True,
    "Please read our privacy policy before you go on.": True,
    # No words.
    "": False,
    "   ": False,
}


def test_lines(spark):
    frame = spark.createDataFrame([(line,) for line in LINES], "line STRING")
    got = {r[0]: r[1] for r in frame.select("line", quality.line_fails(F.col("line"))).collect()}
    assert got == LINES


WORDS = [a + b for a in ("ri", "hou", "sto", "wal", "un", "bri", "ne", "tal", "mo") for b in
         ("ver", "se", "ne", "ks", "der", "ght", "ters", "ming", "dow", "bel", "lan", "ry")]


def prose(rng, n):
    words = WORDS
    make = lambda: " ".join(rng.choices(words, k=rng.randint(6, 14))).capitalize() + "."
    return "\n".join(" ".join(make() for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.mark.parametrize("kind", ["menus", "marks", "open ends", "clean", "clean with a menu"])
def test_planted_texts(spark, kind):
    rng = random.Random(kind)

    def made():
        text = prose(rng, 12)
        if kind == "menus":
            item = lambda: rng.choice(WORDS) + rng.choice(WORDS)
            bars = [" | ".join(item() for _ in range(rng.randint(3, 8))) for _ in range(25)]
            return "\n".join([*bars, *text.split("\n")[:1]])
        if kind == "marks":
            return " ".join(w + rng.choice(["###", "$$$", "&&&", "!!"]) for w in text.split())
        if kind == "open ends":
            tail = lambda: " " + " ".join(rng.choices(WORDS, k=14))
            return "\n".join(line.rstrip(".") + tail() for line in text.split("\n"))
        return f"Home | News | Shop | Help\n{text}" if kind == "clean with a menu" else text

    frame = spark.createDataFrame([(i, made()) for i in range(60)], "doc_id INT, text STRING")
    kept = [r for r in quality.quality(frame).collect() if not r.base_failed]
    assert len(kept) >= 40
    share = sum(r.kept for r in kept) / len(kept)
    assert share >= 0.9 if kind.startswith("clean") else share <= 0.1
    if kind == "clean with a menu":
        assert not any("Home |" in r.clean_text for r in kept)


def test_kept_texts_by_label(spark, directory):
    """Nine tenths of the texts that are labelled good stay, and few of those labelled bad."""
    path = directory.replace("sf0.001", "sf0.01")
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").collect()}
    rows = queries.QUERIES["op7_quality_rules"](spark, path).collect()
    kept = {0: [], 1: []}
    for r in rows:
        if good.get(r.doc_id) is not None and r.n_words >= 50:
            kept[good[r.doc_id]].append(r.kept)
    assert sum(kept[1]) >= 0.95 * len(kept[1]) and sum(kept[0]) <= 0.4 * len(kept[0])
