"""Versions of stored entries, and betweenness against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from sparquill.operators import graph
from sparquill.sources.snapshots import Snapshots

ENTRY = "kind string, id long, value string"


def entries(df):
    return {(r.kind, r.id): r.value for r in df.collect()}


def test_versions_read_as_they_were(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"), ("kind", "id"), ("kind",))
    assert store.last() == 0 and store.manifests().count() == 0 and store.vacuum() == 0
    rng, truth, seen = random.Random(2), {}, {}
    for turn in range(6):
        if turn == 3:
            gone = rng.sample(sorted(truth), 5) + [("doc", 999)]
            version = store.delete(spark.createDataFrame([(k, i, 1) for k, i in gone], "kind string, id long, extra int"))
            truth = {k: v for k, v in truth.items() if k not in gone}
        elif turn == 4:
            version = store.compact()
        else:
            new = {(rng.choice(("doc", "page")), rng.randrange(30)): rng.choice(("a", "", None, f"v{turn}")) for _ in range(12)}
            version = store.put(spark.createDataFrame([(*k, v) for k, v in new.items()], ENTRY))
            truth = truth | new
        seen[version] = dict(truth)
    assert sorted(seen) == [1, 2, 3, 4, 5, 6] and entries(store.read()) == truth
    assert all(entries(store.read(v)) == want for v, want in seen.items())
    for a, b in ((1, 3), (3, 4), (4, 5), (2, 6)):
        want = {(*k, "added" if k not in seen[a] else "removed" if k not in seen[b] else "changed") for k in seen[a].keys() | seen[b].keys() if k not in seen[a] or k not in seen[b] or seen[a][k] != seen[b][k]}
        assert {tuple(r) for r in store.changes(a, b).collect()} == want
    plan = store.read(3).where("kind = 'doc'")._jdf.queryExecution().toString()
    assert plan.count("PartitionFilters: [isnotnull(kind") >= 3  # reads that kind's folders alone, in every version
    with pytest.raises(ValueError):
        store.read(7)


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"), ("kind", "id"), ("kind",))
    store.put(spark.createDataFrame([("doc", 1, "a")], ENTRY))
    broken = spark.range(20, numPartitions=4).select(F.lit("doc").alias("kind"), "id", F.when(F.col("id") == 17, F.raise_error(F.lit("lost")).cast("string")).otherwise("b").alias("value"))
    with pytest.raises(Exception, match="lost"):
        store.put(broken)
    assert store.last() == 1 and entries(store.read()) == {("doc", 1): "a"}
    assert store.vacuum() == 1 and store.vacuum() == 0 and entries(store.read()) == {("doc", 1): "a"}


def brute_betweenness(nodes, edges):
    near = {n: {b for a, b in edges if a == n and b != n} for n in nodes}

    def ways(s):
        dist, count, front = {s: 0}, {s: 1}, [s]
        while front:
            ahead = {}
            for v in front:
                for w in near[v]:
                    if w not in dist:
                        ahead[w] = ahead.get(w, 0) + count[v]
            dist |= {w: dist[front[0]] + 1 for w in ahead}
            count |= ahead
            front = sorted(ahead)
        return dist, count

    every = {s: ways(s) for s in nodes}
    out = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.permutations(nodes, 2):
        for v in nodes:
            if v not in (s, t) and t in every[s][0] and v in every[s][0] and t in every[v][0] and every[s][0][v] + every[v][0][t] == every[s][0][t]:
                out[v] += every[s][1][v] * every[v][1][t] / every[s][1][t]
    n = len(nodes)
    return {v: round(x / ((n - 1) * (n - 2) if n > 2 else 1), 9) for v, x in out.items()}


@pytest.mark.parametrize("batch", [256, 4])
def test_betweenness_equals_brute_force(spark, batch):
    rng = random.Random(batch)
    nodes = [f"n{i}" for i in range(11)]
    edges = [(rng.choice(nodes[:10]), rng.choice(nodes[:10])) for _ in range(22)]
    edges += edges[:3]
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = {r.id: r.betweenness for r in graph.betweenness(table([(n,) for n in nodes], "id string"), table(edges, "src string, dst string"), batch).collect()}
    assert got == pytest.approx(brute_betweenness(nodes, edges)) and max(got.values()) > 0
    alone = graph.betweenness(table([("a",), ("b",)], "id string"), table([], "src string, dst string"), batch)
    assert {tuple(r) for r in alone.collect()} == {("a", 0.0), ("b", 0.0)}


def test_betweenness_takes_sources_alike_as_one(spark, monkeypatch):
    """A star of many sources is one batch, and counts as often as it has sources; hubs and near twins keep their own."""
    rng = random.Random(7)
    nodes = [f"n{i}" for i in range(6)] + [f"s{i}" for i in range(14)]
    edges = [(rng.choice(nodes[:6]), rng.choice(nodes[:6])) for _ in range(12)] + [(f"s{i}", f"n{i % 3}") for i in range(12)] + [("s12", "n0"), ("s12", "n1"), ("s13", "n1"), ("s13", "n0")]
    rounds = []
    settle = graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: rounds.append(df) or settle(df))
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    for links in (32, 1):  # with 1, the sources of two links stand for themselves
        monkeypatch.setattr(graph, "TWIN_LINKS", links)
        rounds.clear()
        got = {r.id: r.betweenness for r in graph.betweenness(table([(n,) for n in nodes], "id string"), table(edges, "src string, dst string"), 4).collect()}
        assert got == pytest.approx(brute_betweenness(nodes, edges)) and max(got.values()) > 0
        assert len(rounds) < 30
