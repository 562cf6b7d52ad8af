"""Nearest vectors and the index of inverted lists against plain loops."""

import numpy as np
import pytest

from sparquill.operators import nearest
from sparquill.operators.vector_index import VectorIndex, fitted

SCHEMA = "vec_id long, embedding array<float>, label int, list int, score double"


def points(seed, n, length=16, groups=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (groups, length))
    return (middle[rng.integers(0, groups, n)] + rng.normal(0, 0.4, (n, length))).astype(np.float32)


def table(spark, v, first=0):
    return spark.createDataFrame([(first + i, x.tolist(), 1, 2, 0.5) for i, x in enumerate(v)], SCHEMA).repartition(4)


def plain(v, ids, q, query_ids, k, metric):
    out = {}
    for x, i in zip(q.astype(float), query_ids, strict=True):
        rows = []
        for y, j in zip(v.astype(float), ids, strict=True):
            if metric in ("cosine", "dot", "clamped"):
                s = float(x @ y)
                s = s / (np.sqrt(x @ x) * np.sqrt(y @ y)) if metric == "cosine" and (x @ x) * (y @ y) > 0 else 0.0 if metric == "cosine" else s
                s = min(max(s, 0.0), 1.0) if metric == "clamped" else s
            else:
                s = 1 / (1 + (np.sqrt(((x - y) ** 2).sum()) if metric == "euclidean" else np.abs(x - y).sum()))
            if i != j:
                rows.append((-round(s, 6), j))
        out[i] = [(j, -s) for s, j in sorted(rows)[:k]]
    return out


def taken(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.place)):
        out.setdefault(r.query_id, []).append((r.id, r.score))
    return out


@pytest.mark.parametrize("metric", ["cosine", "dot", "clamped", "euclidean", "manhattan"])
def test_nearest_equals_plain_loops(spark, monkeypatch, metric):
    v = points(1, 150)
    v[7] = 0
    v[20:26] = v[19]  # equal vectors: ties by id
    want = plain(v, range(150), v[::20], range(0, 150, 20), 5, metric)
    odd = spark.createDataFrame([(1000, None, 1, 2, 0.5), (1001, [1.0, 2.0], 1, 2, 0.5), (None, [1.0] * 16, 1, 2, 0.5), (1002, [float("nan")] * 16, 1, 2, 0.5)], SCHEMA)
    vectors, asked = table(spark, v).unionByName(odd), table(spark, v).where("vec_id % 20 = 0")
    got = taken(nearest.nearest(vectors, asked, 5, metric))
    assert {i: [x[0] for x in r] for i, r in got.items()} == {i: [x[0] for x in r] for i, r in want.items()}
    assert all(abs(a[1] - b[1]) < 2e-6 for i in got for a, b in zip(got[i], want[i]))
    monkeypatch.setattr(nearest, "SLOT_ROWS", 40)
    monkeypatch.setattr(nearest, "CHUNK_ROWS", 3)
    assert taken(nearest.nearest(vectors, asked, 5, metric, most=100)) == got
    assert nearest.nearest(vectors, asked.limit(0), 5).count() == 0 == nearest.nearest(vectors.limit(0), asked, 5).count()
    least = sorted(s for r in got.values() for _, s in r)[10]
    assert taken(nearest.nearest(vectors, asked, 5, metric, least)) == {i: x for i, r in got.items() if (x := [y for y in r if y[1] >= least])}


@pytest.mark.parametrize("cosine", [True, False])
def test_index_finds_the_nearest(spark, monkeypatch, cosine, tmp_path):
    v = points(2, 3000)
    vectors = table(spark, v)
    asked = vectors.where("vec_id % 20 = 0")
    index = VectorIndex.build(vectors, cosine=cosine)
    assert index.sizes().sum() == 3000 and len(index.centroids) == 54
    exact = taken(index.exact(asked, 10))
    assert exact == taken(nearest.nearest(vectors, asked, 10, "cosine" if cosine else "euclidean"))

    def recall(some):
        got = taken(some)
        return sum(len({x[0] for x in got[i]} & {x[0] for x in r}) for i, r in exact.items()) / sum(map(len, exact.values()))

    found = index.search(asked, 10)
    assert recall(found) >= 0.9 and index.probes < len(index.centroids)
    assert taken(index.search(asked, 10, probes=len(index.centroids))) == exact
    monkeypatch.setattr(nearest, "SLOT_ROWS", 30)
    monkeypatch.setattr(nearest, "CHUNK_ROWS", 7)
    assert taken(index.search(asked, 10, most=100)) == taken(found)  # the way of very many queries
    index.write(str(tmp_path / "index"))
    back = VectorIndex.read(spark, str(tmp_path / "index"))
    assert taken(back.search(asked, 10)) == taken(found)
    one = back.search(asked.limit(1), 10, probes=1)
    assert "PartitionFilters: [list" in one._jdf.queryExecution().toString().replace("isnotnull(list", "list")  # reads its lists alone


def test_index_follows_changes_and_splits_large_lists(spark):
    v = points(3, 600)
    vectors = table(spark, v)
    index = VectorIndex.build(vectors, lists=10)
    moved = points(4, 100)
    changed = index.add(table(spark, moved, 550)).remove(spark.createDataFrame([(i,) for i in range(100)] * 2, "vec_id long"))
    now = np.r_[v[100:550], moved]
    ids = [*range(100, 650)]
    assert sorted(r.vec_id for r in changed.rows.collect()) == ids
    asked = table(spark, moved, 550).where("vec_id % 20 = 0")
    exact = taken(changed.exact(asked, 5))
    assert exact == taken(changed.search(asked, 5, probes=10))
    want = plain(now, ids, moved[10::20], range(560, 650, 20), 5, "cosine")
    assert {i: [x[0] for x in r] for i, r in exact.items()} == {i: [x[0] for x in r] for i, r in want.items()}
    crowd = changed.add(table(spark, points(5, 1500, groups=3), 1000))
    even = crowd.rebalanced(times=1.5)
    assert len(even.centroids) > len(crowd.centroids) and even.sizes().max() < crowd.sizes().max() and even.sizes().sum() == 2050
    assert taken(even.exact(asked, 5)) == taken(crowd.exact(asked, 5))
    copies = VectorIndex.build(table(spark, np.repeat(v[:1], 400, 0)), lists=4)
    assert copies.rebalanced().sizes().sum() == 400 and len(taken(copies.search(table(spark, v[:1], 9000), 5))[9000]) == 5
    none = VectorIndex.build(vectors.limit(0))
    assert none.rows.count() == 0 and none.sizes().sum() == 0


def test_fitted_uses_every_list():
    v = np.r_[np.zeros((50, 3)), np.eye(3)].astype(float)
    centroids = fitted(v, 10, False)
    assert len(centroids) == 4 and len(np.unique((v @ centroids.T - (centroids**2).sum(1) / 2).argmax(1))) == 4
