"""All pairs of words count: no word is too rare to be scored by the word ahead of it."""

import collections
import random
import re

import numpy as np

from sparquill.llm import perplexity, word_pairs


def brute(texts):
    """Mean bits a word by pairs and by words, from the definition."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    ahead, behind = collections.defaultdict(set), collections.defaultdict(set)
    for w in words:
        for g, h, x in zip(["<s>", "<s>", *w], ["<s>", *w], w):
            ahead[x].add(h)
            behind[h, x].add(g)
    of_counts = lambda counts: perplexity.discounts(*(sum(c == i for c in counts) for i in (1, 2, 3, 4)))
    count, total = {x: len(v) for x, v in ahead.items()}, sum(map(len, ahead.values()))
    cut = of_counts(count.values())
    taken = sum(cut[min(c, 3)] for c in count.values())
    own = {x: (c - cut[min(c, 3)]) / total + taken / total / len(count) for x, c in count.items()}
    pairs = {k: len(v) for k, v in behind.items() if k[0] != "<s>"}
    two = [0, 1, *of_counts(pairs.values())[2:]]
    weight, kept = collections.Counter(), collections.Counter()
    for (h, _), c in pairs.items():
        weight[h] += c
        kept[h] += c - two[min(c, 3)]

    def p(h, x):
        return own[x] if h not in weight else (pairs.get((h, x), two[0]) - two[min(pairs.get((h, x), 0), 3)]) / weight[h] + (1 - kept[h] / weight[h]) * own[x]

    for h in list(weight)[:5]:
        assert abs(sum(p(h, x) for x in own) - 1) < 1e-9  # a distribution
    by_pairs = [-sum(np.log2(p(h, x)) for h, x in zip(["<s>", *w], w)) / max(len(w), 1) for w in words]
    return by_pairs, [-sum(np.log2(own[x]) for x in w) / max(len(w), 1) for w in words]


def test_all_pairs_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("the of and to in a".split()) if rng.random() < 0.4 else f"w{int(rng.expovariate(0.02))}" for _ in range(rng.randint(1, 90))) for _ in range(80)]
    texts += [texts[0], texts[0], "", None, "\n", "only", " ".join("UPPER!!" for _ in range(30))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    pairs, words = brute(texts)
    for size in (1 << 25, 500):  # one chunk a part, and some
        monkeypatch.setattr(word_pairs, "CHUNK", size)
        got = {r.doc_id: r for r in perplexity.quality_rules(docs).collect()}
        assert len(got) == len(texts)
        assert all(abs(np.log2(got[i].perplexity) - pairs[i]) < 1e-9 and abs(np.log2(got[i].word_perplexity) - words[i]) < 1e-9 for i in range(len(texts)))
        assert all(r.kept == (not r.base_failed and r.word_low <= r.word_perplexity <= r.word_high and r.perplexity <= r.high) for r in got.values())


def test_rare_pairs_tell_order_from_salad(spark):
    """Words far below 1/1000 of all pairs: texts of usual phrases are likelier than the same words in another order."""
    rng = random.Random(5)
    phrases = [" ".join(f"v{rng.randrange(6000)}" for _ in range(4)) for _ in range(1500)]
    texts = [" ".join(rng.choice(phrases) for _ in range(40)) for _ in range(400)]
    salad = []
    for t in texts[:5]:
        w = t.split()
        rng.shuffle(w)
        salad.append(" ".join(w))
    got = {r.doc_id: r for r in perplexity.quality_rules(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts + salad)], "doc_id long, text string, lang string")).collect()}
    assert sum(got[i].kept for i in range(400)) > 380 and not any(got[400 + i].kept for i in range(5))


def test_more_partitions_than_asked(spark, monkeypatch):
    from pyspark import RDD

    docs = spark.createDataFrame([(i, f"a b c{i % 3} d e f g h i j k{i}", "en") for i in range(20)], "doc_id long, text string, lang string").repartition(3)
    want = sorted(map(tuple, word_pairs.score_documents(docs).collect()))
    monkeypatch.setattr(RDD, "partitionBy", lambda self, n, *a, f=RDD.partitionBy: f(self, max(n, 11), *a))
    assert len(want) == 20 and sorted(map(tuple, word_pairs.score_documents(docs).collect())) == want
