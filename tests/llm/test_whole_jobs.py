
import collections
import random

import numpy as np

from sparquill.llm import byte_cnn, mixing, pii
from sparquill.llm.common import Scratch


def test_secrets_are_masked_to_their_end():
    for n in (8, 199, 200, 201, 5000):
        value = ("aB3_" * n)[:n]
        for t in (f"token = {value} after", f'api_key: "{value}" after', f"password={value}"):
            start = t.index(value)
            assert (start, pii.SECRET, start + n) in pii.find_spans(t)[1]
            masked = pii.redacted(t, pii.find_spans(t)[1])
            assert "aB3_" not in masked and masked == t.replace(value, "[SECRET]")


def test_classifier_learns_from_whole_texts(spark, monkeypatch):
    texts = {i: f"{i} " + "é word " * (20 if i % 2 else 3000) + f"end {i}" for i in range(12)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in texts], "doc_id long, quality int")
    taught = []
    monkeypatch.setattr(byte_cnn, "train", lambda raws, quality: taught.extend(raws) or byte_cnn.constant(0.5))
    byte_cnn.fit(docs, labels)
    assert len(taught) > 3 and set(taught) <= {t.encode() for t in texts.values()} and max(map(len, taught)) > 20_000


def test_wide_raking_equals_the_driver(spark):
    rng = np.random.default_rng(1)
    cells = {(f"s{i}", f"l{j}", str(k)): int(rng.integers(1, 500)) for i in range(30) for j in range(4) for k in range(8) if rng.random() < 0.2}
    cells |= {(f"s{i}", f"l{i % 4}", "0"): 0 for i in range(3)}
    table = spark.createDataFrame([(*k, n) for k, n in cells.items()], "source string, lang string, topic string, tokens long").coalesce(1)
    targets = {"source": 0.7, "lang": {"l0": 0.4, "l1": 0.1}, "topic": 0.5}
    near = table.toPandas().sort_values(list(mixing.KEYS), ignore_index=True)
    near["probability"] = mixing.rake(near, targets, 0.3, rounds=2)
    far = mixing.rake_wide(table, targets, 0.3, Scratch(spark), rounds=2).toPandas().sort_values(list(mixing.KEYS), ignore_index=True)
    assert np.allclose(far["probability"], near["probability"], rtol=1e-7, atol=1e-9)


def test_topics_follow_subjects(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        lang, subject = ("en", "de")[i % 2], i // 2 % 3
        usual = [f"{lang}stop{min(int(rng.expovariate(0.4)), 9)}" for _ in range(60)]
        own = [f"{lang}{subject}word{rng.randrange(40)}" for _ in range(25)]
        words = usual + own
        rng.shuffle(words)
        rows.append((i, " ".join(words), lang, "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    subjects = collections.defaultdict(collections.Counter)
    for r in mixing.measure(docs).collect():
        subjects[r.lang, r.topic][r.doc_id // 2 % 3] += 1
    assert sum(max(x.values()) for x in subjects.values()) > 0.9 * 600
