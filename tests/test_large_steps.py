"""Steps of findings in FINDINGS_r03.md that were made to grow with their input: the same results as plain definitions, and what they hold or move is bounded."""

import collections
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparquill.functions import text as tx
from sparquill.operators import evaluate, nearest, profile, relations, rerank
from sparquill.streaming import events as stream

WORDS = ["the", "of", "ä", "Straße", "𝒳y", "the,", "other", "THE", "x", "İ"]


def some_texts(seed, n):
    rng = random.Random(seed)
    return [None, "", " \n", *(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 14))) for _ in range(n))]


def test_pair_metrics_equal_the_column_functions(spark):  # F7, F10
    a, b = some_texts(1, 40), some_texts(2, 40)
    rows = spark.createDataFrame(list(zip(range(len(a)), a, b[::-1], strict=True)), "id int, a string, b string").where("a is not null and b is not null")
    wa, wb = tx.words(F.col("a")), tx.words(F.col("b"))
    want = rows.select("id", *(F.round(c, 6).alias(k) for k, c in {"cosine": evaluate.text_cosine(wa, wb), "bleu_2": evaluate.bleu(wa, wb, 2), "rouge_l": evaluate.rouge_l(wa, wb), "common": tx.common_length(wa, wb), "entropy_rate": evaluate.entropy_rate(wa)}.items()))
    found = evaluate.pair_metrics(rows, ["id"])
    assert found.columns == want.columns and {r.id: pytest.approx(tuple(r), nan_ok=True) for r in found.collect()} == {r.id: tuple(r) for r in want.collect()}
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()  # no table of words by words as arrays
    assert evaluate._longest_common(list("abcbdab"), list("bdcaba")) == 4


def test_cross_scores_equal_all_pairs_of_words(spark):  # F5
    q, d = some_texts(3, 20), some_texts(4, 20)
    rows = spark.createDataFrame(list(zip(range(len(q)), q[::-1], d, strict=True)), "id int, query string, document string")
    low = lambda k: F.transform(tx.words(F.col(k)), F.lower)
    each = rows.select("id", F.explode(low("query")).alias("x"), low("document").alias("d")).select("id", "x", F.explode("d").alias("y")).select("id", rerank.token_likeness(F.col("x"), F.col("y")).alias("s"))
    want = collections.defaultdict(list)
    for r in each.collect():
        want[r.id].append(r.s)
    found = rerank.cross_scores(rows, ["id"])
    assert "token_likeness" not in str(found) and "transform" not in str(found._jdf.queryExecution().optimizedPlan().toString()).split("MapInArrow")[0]
    got = {r.id: r for r in found.collect()}
    assert len(got) == len(q)
    for i, s in want.items():
        assert got[i].neural == round(1 / (1 + math.exp(-4 * sum(v**3 for v in s) / (sum(v * v for v in s) or 1))), 6)
        nq, nd = len(q[::-1][i].split()), len(d[i].split())
        hits = [v for v in s if v > 0.3]
        assert got[i].plain == pytest.approx(min(sum(hits) / nq / (1 + nd / 100) + 0.2 * (len(hits) / nq > 0.5), 1), abs=2e-6)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_gram_counts_equal_the_grams(spark, n):  # F9
    texts = [*some_texts(5, 30), "a    b", "     ", "\t  \t", "𝒳𝒳𝒳𝒳𝒳𝒳"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    g = tx.char_grams(F.col("text"), n)
    want = {tuple(r) for r in docs.select("doc_id", F.size(g), F.size(F.array_distinct(g))).collect() if r[1] > 0}
    assert {tuple(r) for r in profile.gram_counts(docs, n).collect()} == want and len(want) > 10


def test_signals_split_a_text_once(spark):  # F11, F17
    docs = spark.createDataFrame(list(enumerate(some_texts(6, 10))), "doc_id long, text string")
    values = rerank.signals(docs, "the of")
    assert values._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert "Join" in (plan := rerank.scaled(values, "min_max")._jdf.queryExecution().optimizedPlan().toString()) and "split(" not in plan  # written once, then read


def test_tokens_move_as_runs(spark):  # F15
    texts = some_texts(7, 30)
    tokens = stream.token_stream(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = {i: (len(w := t.split()) + 1, len(w), "".join(x + " " for x in w)) for i, t in enumerate(texts) if t is not None}
    for rows in (tokens.coalesce(1), tokens.repartition(5), tokens.orderBy(F.desc("position"))):
        got = {r.doc_id: tuple(r)[1:] for r in stream.collected(rows).collect()}
        assert got.keys() == want.keys()
        assert {i: r[2] for i, r in got.items()} == {i: hashlib.md5(t.encode()).hexdigest() for i, (_, _, t) in want.items()}
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 1, 1, 2, 2, 1, None, None], "position": [0, 1, 2, 0, 2, 3, 0, 1], "token": ["a ", "b ", "", "c ", "d ", "e ", "f ", "g "]})
    assert next(stream._runs(iter([batch]))).column("text").to_pylist() == ["a b ", "c ", "d ", "e ", "f ", "g "]


def test_spans_come_by_few_texts(spark, monkeypatch):  # F16
    docs = spark.createDataFrame([(i, f"Dr. Ann Miller{i % 7} met Bob Stone in Paris") for i in range(50)], "doc_id long, text string").coalesce(1)
    rows = lambda: sorted(tuple(r)[1:] for r in relations.spans(docs).collect())
    whole = rows()
    monkeypatch.setattr(relations, "ROWS", 3)
    assert rows() == whole and len(whole) >= 50


def test_a_worker_holds_few_scores(monkeypatch):  # F13, F14
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(5000, 8)), rng.normal(size=(900, 8))
    held, plain = [], nearest.scores
    monkeypatch.setattr(nearest, "scores", lambda *a: held.append(plain(*a)) or held[-1])
    sorts, k_best = [], nearest.k_best
    monkeypatch.setattr(nearest, "k_best", lambda *a: sorts.append(1) or k_best(*a))
    best = nearest.Best(np.arange(900), q, "cosine", 5, None)
    best.see(np.arange(5000) + 10_000, v)
    assert max(x.size for x in held) <= 1 << 20 and len(held) > 1 and len(sorts) == 1
    want = np.sort(np.round(plain(v, q, "cosine"), 6), 1)[:, ::-1][:, :5]
    assert np.array_equal(best.rows[2].reshape(900, 5), want + 0.0)
