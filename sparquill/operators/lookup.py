"""Answers of a cache found by equal, equal but for spelling, or like questions."""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.rounds import settled

A_TASK = 10_000  # entries that meet twice as many questions in a task


def spelled_alike(text: Column) -> Column:
    """Lower case, letters, digits and single spaces only: what else stands between letters is gone, not a space."""
    bare = F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}\\s]", "")
    return F.trim(F.regexp_replace(bare, "\\s+", " "))


def _alike_in_task(least: float):
    """Of questions and entries that met in a task, the pairs that are `least` alike or more."""

    def met(asked: pa.Table, entries: pa.Table) -> pa.Table:
        ids, lists = asked["id"].to_pylist(), asked["words"].to_pylist()
        times = Counter(w for words in entries["words"] for w in set(words.as_py()))
        counts, sizes = [Counter(own) for own in lists], [len(own) for own in lists]
        first = defaultdict(list)  # the questions among whose rarest words a word is
        for i, own in enumerate(counts):
            left, enough = sizes[i], max(least * len(own), least * (sizes[i] + 1) / (1 + least)) - 1e-9
            for w in sorted(own, key=lambda w: (times[w], w)):
                if left < enough:
                    break
                first[w].append(i)
                left -= own[w]
        out = []
        for entry, words in zip(entries["id"].to_pylist(), entries["words"], strict=True):
            words = words.as_py()
            n, known = len(words), set(words)
            for i in set().union(*(first[w] for w in known if w in first)):
                if sizes[i] < n * least - 1e-9:
                    continue
                both = sum(t for w, t in counts[i].items() if w in known)
                likeness = both / max(sizes[i] + n - both, 1)
                if likeness >= least:
                    out.append((ids[i], entry, likeness))
        columns = zip(*out, strict=True) if out else ((), (), ())
        kinds = (asked.schema.field("id").type, entries.schema.field("id").type, pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "entry", "likeness"])

    return met


def like_questions(asked: DataFrame, entries: DataFrame, least: float, a_task: int = A_TASK) -> DataFrame:
    """(id, entry, likeness) of all pairs of asked (id, words) and entries (id, words) that are `least` alike or more; ids are unique.

    Likeness is the number of the question's words that the entry has, each as
    often as it was asked, over the words of both less that number: Jaccard's,
    with words counted as they stand. Entries are dealt to slots of `a_task`, and
    twice as many questions to a chunk; each chunk meets each slot in a task,
    whatever words they have in common, and only pairs that are alike leave it.

    Exact: a question of w different words among n must find `least` * w and
    `least` * (n + 1) / (1 + `least`) of its words in the entry, so its words,
    from the rarest in the slot on to where fewer are left, must hold one.
    """
    slots, chunks = (max(1, -(-df.count() // rows)) for df, rows in ((entries, a_task), (asked, 2 * a_task)))
    dealt = lambda name, n: F.pmod(F.xxhash64("id"), F.lit(n)).alias(name)
    every = lambda name, n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    mine = asked.select("id", "words", dealt("chunk", chunks), every("slot", slots)).groupBy("slot", "chunk")
    theirs = entries.select("id", "words", dealt("slot", slots), every("chunk", chunks)).groupBy("slot", "chunk")
    kind = lambda df: df.schema["id"].dataType.simpleString()
    return mine.cogroup(theirs).applyInArrow(_alike_in_task(least), f"id {kind(asked)}, entry {kind(entries)}, likeness double")


def cached_answers(asked: DataFrame, cache: DataFrame, least: float = 0.8, a_task: int = A_TASK) -> DataFrame:
    """asked (id, question) with tier, entry and likeness of the entry (id, question) that answers it: equal, spelled alike, or the likest.

    Entries that no longer count are to be left out by the caller. An entry never
    answers the question of its own id, so a log can be held against itself. Of
    equal ones the least id counts. Questions without an answer have nulls; null
    questions and such without words find equal ones only. ids are unique.
    """
    ask = settled(asked.select("id", "question", spelled_alike(F.col("question")).alias("alike")))
    have = settled(cache.select("id", "question", spelled_alike(F.col("question")).alias("alike")))

    def two_least(key: str) -> DataFrame:
        # the least id of each text, and the next for the question that has the least itself
        first = have.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("least"))
        others = have.join(first, key).where(F.col("id") != F.col("least")).groupBy(key).agg(F.min("id").alias("next"))
        return first.join(others, key, "left")

    def hits(key: str, tier: str) -> DataFrame:
        met = ask.where(F.col(key) != "").join(two_least(key), key)
        entry = F.when(F.col("least") != F.col("id"), F.col("least")).otherwise(F.col("next"))
        return met.select("id", F.lit(tier).alias("tier"), entry.alias("entry"), F.lit(1.0).cast("double").alias("likeness")).where("entry is not null")

    equal, alike = hits("question", "equal"), hits("alike", "alike")
    open_ = ask.join(equal.select("id"), "id", "left_anti").join(alike.select("id"), "id", "left_anti").where("alike <> ''")
    # each spelling once on both sides: groups of copies meet as one, and none that is left has an equal but itself
    spell = lambda x: x.groupBy("alike").agg(F.min("id").alias("id")).select("id", F.split("alike", " ").alias("words"), "alike")
    mine, theirs = settled(spell(open_)), settled(spell(have.where("alike <> ''")))
    itself = mine.join(theirs.select("alike", F.col("id").alias("itself")), "alike", "left").select("id", "itself")
    met = like_questions(mine, theirs, least, a_task).join(itself, "id").where("itself is null or entry <> itself")
    best = met.groupBy("id").agg(F.max(F.struct("likeness", (-F.col("entry")).alias("behind"))).alias("b"))
    best = mine.join(best, "id").select("alike", "b").join(open_.select("id", "alike"), "alike")
    like = best.select("id", F.lit("like").alias("tier"), (-F.col("b.behind")).alias("entry"), F.round("b.likeness", 6).alias("likeness"))
    answers = equal.unionByName(alike.join(equal.select("id"), "id", "left_anti")).unionByName(like)
    return asked.select("id").join(answers, "id", "left")
