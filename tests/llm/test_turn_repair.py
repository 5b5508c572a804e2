"""Repairs of conversations against all edits, and over segments."""

import functools
import hashlib
import random

import pytest

from tablewright.llm import turn_repair
from tests.llm.conftest import LONG

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, _id INT, part INT, kind STRING"
NEXT = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def kinds(rows):
    seen, found = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else ""
        if not kind and bare[-1] not in ".!?":
            kind = "truncated"
        seen.add((role, text))
        found.append(kind)
    return found


def brute(rows):
    """The least (cost, edits, repaired rows) over all edits, from the end."""
    faults = kinds(rows)
    words = {"u": "user", "a": "assistant"}

    @functools.cache
    def best(i, state, inserted):
        ways = []
        if i == len(rows) and state in "0a":
            ways.append((0, "", ()))
        if inserted < 2:
            for letter, word in words.items():
                if to := NEXT.get((state, letter)):
                    cost, audit, rest = best(i, to, inserted + 1)
                    ways.append((cost + 5, "I" + audit, ((word, ""), *rest)))
        if i < len(rows):
            role, text = rows[i]
            cost, audit, rest = best(i + 1, state, 0)
            ways.append((cost + 2, "D" + audit, rest))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                if to := NEXT.get((state, role[:1])):
                    cost, audit, rest = best(i + 1, to, 0)
                    ways.append((cost + more, "K" + audit, ((role, text), *rest)))
                for letter, word in words.items():
                    if to := NEXT.get((state, letter)):
                        cost, audit, rest = best(i + 1, to, 0)
                        ways.append((cost + more + 1, "R" + audit, ((word, text), *rest)))
        return min(ways, default=(10**6, "~", ()))

    return best(0, "0", 0)


def sha(turns):
    return hashlib.sha256("\n".join(f"{role}:{text}" for role, text in turns).encode()).hexdigest()


def made_up(seed, n, length):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = 0
        for _ in range(rng.randint(1, length)):
            turn += rng.choice([1, 1, 1, 2, 0])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "$"])
            text = rng.choice(["Yes.", "No!", "Why?", "It ends", "", " \n", f"Number {rng.random()}."])
            rows.append((conv, turn, role, text))
    return rows


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0], r[1], r[2], hashlib.md5(r[3].encode()).hexdigest()))


def check(spark, rows):
    frame = spark.createDataFrame([(*r, 0, 0, "x") for r in rows], SCHEMA)
    made = turn_repair.repair(frame)
    turns = {}
    for t in sorted(made.turns.collect(), key=lambda t: (t._id, t.part, t.segment, t.at)):
        turns.setdefault(t._id, []).append((t.role, t.text))
    got = {r._id: r for r in made.summaries.collect()}
    conversations = {}
    for r in in_order(rows):
        conversations.setdefault(r[0], []).append(r)
    assert set(got) == set(conversations)
    for conv, found in conversations.items():
        plain = [(role, text) for _, _, role, text in found]
        cost, audit, repaired = brute(tuple(plain))
        r, faults = got[conv], kinds(plain)
        assert (r.cost, r.audit) == (cost, audit)
        assert tuple(turns.get(conv, ())) == repaired and r.repaired_sha256 == sha(repaired)
        assert (r.blank, r.duplicate, r.truncated) == tuple(
            faults.count(kind) for kind in ("blank", "duplicate", "truncated")
        )
        numbers = [turn for _, turn, _, _ in found]
        assert r.gaps == max(numbers) - min(numbers) + 1 - len(set(numbers))
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(plain, plain[1:])]
        assert r.illegal == sum(pair not in ("su", "ua", "au") for pair in pairs)


def test_against_all_edits(spark):
    check(spark, made_up(1, 400, 9))


def test_segments(spark, monkeypatch):
    """Segments of two rows: every conversation is folded from tables."""
    monkeypatch.setattr(turn_repair, "SEGMENT_ROWS", 2)
    check(spark, made_up(2, 150, 12))


def test_segments_are_small_in_a_long_conversation(spark):
    rows = [(7, i, ("user", "assistant", "user")[i % 3], f"Text {i}.") for i in range(9000)]
    rows += [(c, i, ("user", "assistant")[i], f"Text {c}.") for c in range(20, 400) for i in range(2)]
    frame = spark.createDataFrame([(*r, 0, 0, "x") for r in rows], SCHEMA)
    made = turn_repair.repair(frame)
    got = {r._id: r for r in made.summaries.collect()}
    assert len(got) == 381 and got[399].audit == "KK"
    plain = [{"role": r[2], "text": r[3], "kind": 0, "copies": 1} for r in rows[:9000]]
    assert (got[7].cost, got[7].audit) == turn_repair.ended(turn_repair.parsed(plain, 0))[0]
    segments = [r.segment for r in made.turns.where("_id = 7").select("part", "segment").distinct().collect()]
    assert len(segments) >= 5


def test_copies_of_a_row(spark):
    rows = [(1, 0, "user", "Go on.")] * 5000 + [(1, 1, "assistant", "Yes.")] + [(2, 0, "user", "")] * 3
    frame = spark.createDataFrame([(*r, 0, 0, "x") for r in rows], SCHEMA)
    got = {r._id: r for r in turn_repair.repair(frame).summaries.collect()}
    assert (got[1].audit, got[1].cost) == ("K" + "D" * 4999 + "K", 9998)
    assert (got[1].duplicate, got[1].illegal, got[1].gaps) == (4999, 4999, 0)
    assert (got[2].audit, got[2].blank, got[2].duplicate, got[2].cost) == ("DDD", 3, 0, 6)


def test_edges(spark):
    rows = [
        (1, None, None, None), (None, 0, "user", "Hi."), (None, None, "assistant", "Hello."),
        (2, 0, "user", LONG + "."), (2, 1, "assistant", LONG), (3, 0, "", "Text."),
        (4, 0, "assistant", "One."), (4, 0, "assistant", "Two."), (5, 3, "system", "Only."),
    ]
    frame = spark.createDataFrame([(*r, 0, 0, "x") for r in rows], SCHEMA)
    got = {r._id: r for r in turn_repair.repair(frame).summaries.collect()}
    assert {i: (r.audit, r.cost) for i, r in got.items()} == {
        1: ("D", 2), None: ("RR", 2), 2: ("DD", 4), 3: ("D", 2), 4: ("RK", 1), 5: ("D", 2),
    }
    assert got[2].truncated == 1 and got[1].blank == 1
    assert turn_repair.repair(frame.limit(0)).summaries.collect() == []


def test_table_of_the_grammar():
    for text in ("", "ua", "sua", "uaua", "suaua", "s", "u", "a", "us", "uau", "ss", "aua", "suasua"):
        stack = turn_repair.START
        for symbol in (*text, None):
            stack = stack and turn_repair.advanced(stack, symbol)
        accepted = text.removeprefix("s").replace("ua", "") == "" and text != "s" and text != "suasua"
        assert bool(stack) == (accepted and not text.startswith("ss") and "uas" not in text), text
    assert turn_repair.ended({0: (0, "")}) == ((0, ""), 0)
    with pytest.raises(ValueError):
        turn_repair.ended({3: (0, "K")})
