"""Lookups of questions against all pairs."""

import random

import pytest

from sparquill.operators import lookup


def likeness(own, its):
    both = sum(w in its for w in own)
    return both / max(len(own) + len(its) - both, 1)


def lists(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the"] * 30 + ["of"] * 10 + [f"w{i}" for i in range(25)]
    out = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 1, 2, 3, 5, 9]))] for _ in range(n)]
    for words in out[: n // 2]:  # near copies, with and without repeated words
        near = list(dict.fromkeys(words)) if rng.random() < 0.5 else list(words)
        near[rng.randrange(len(near))] = rng.choice(vocabulary)
        out.append(near)
    return out


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_like_questions_equal_all_pairs(spark, least):
    asked, entries = list(enumerate(lists(1, 60))), list(enumerate(lists(2, 120) + lists(1, 30)))
    table = lambda rows: spark.createDataFrame(rows, "id long, words array<string>").repartition(3)
    got = {(r.id, r.entry): r.likeness for r in lookup.like_questions(table(asked), table(entries), least, a_task=7).collect()}
    want = {(i, j): likeness(own, its) for i, own in asked for j, its in entries if likeness(own, its) >= least}
    assert got == pytest.approx(want) and len(want) > 20
    assert lookup.like_questions(table(asked).limit(0), table(entries), least).count() == 0 == lookup.like_questions(table(asked), table(entries).limit(0), least).count()


def test_tiers_in_order(spark):
    cache = [(1, "How to learn Rust programming?"), (2, "how to learn rust programming"), (3, "What is Spark"), (4, "learn rust programming how to do"), (5, ""), (6, None), (7, "..."), (8, "What is Spark")]
    asked = [(101, "how to learn rust programming"), (102, "HOW to learn   rust, programming"), (103, "learn rust programming how to"), (104, "something else"), (105, None), (106, ""), (107, "..."), (3, "What is Spark"), (108, "rust programming learn to how"), (109, "rust programming learn to how")]
    table = lambda rows: spark.createDataFrame([(*r, 0.5, "x") for r in rows], "id long, question string, likeness double, words string")
    got = {r.id: (r.tier, r.entry, r.likeness) for r in lookup.cached_answers(table(asked), table(cache)).collect()}
    assert got == {
        101: ("equal", 2, 1.0), 102: ("alike", 1, 1.0), 103: ("like", 1, 1.0), 104: (None, None, None), 105: (None, None, None), 106: (None, None, None), 107: ("equal", 7, 1.0), 3: ("equal", 8, 1.0), 108: ("like", 1, 1.0), 109: ("like", 1, 1.0),
    }


def test_only_likely_pairs_leave_a_task(spark):
    """Pairs are told apart where they meet: no candidate is shuffled with the words of both, as many as share a common word."""
    titles = [(i, ["the", "of", *(f"w{i}x{j}" for j in range(3))]) for i in range(60)] + [(100, ["w1x0", "w1x1", "w1x2", "the"]), (101, ["a"] * 40 + ["the"])]
    table = spark.createDataFrame(titles, "id long, words array<string>")
    found = lookup.like_questions(table, table.where("id >= 0"), 0.6, a_task=20)
    assert sorted((r.id, r.entry) for r in found.collect() if r.id != r.entry) == [(1, 100), (100, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan
