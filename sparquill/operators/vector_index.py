"""An index of vectors in inverted lists around centroids, with an exact way beside it.

Centroids are fitted on a sample of bounded rows and bytes; every row of the
table is in the list of its nearest centroid. A search reads the lists nearest
to each query. How many is found while fitting, from the share of true
neighbours that a part of the sample finds in the sample; nearest.nearest() on
the index's rows is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nearest as near

SAMPLE_ROWS, SAMPLE_BYTES = 65_536, 64 << 20  # of the table that centroids are fitted on, at most
RECALL, TRIED, AMONG = 0.97, 256, 10  # aimed at in the sample, by so many of its rows, for so many neighbours


def _unit(v: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norms, out=np.zeros_like(v), where=norms > 0)


def _closeness(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """[vector, centroid]: larger where the distance is less."""
    return v @ centroids.T - (centroids**2).sum(1) / 2


def fitted(v: np.ndarray, lists: int, cosine: bool, seed: int = 0, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's rounds from rows that are spread out; a list left without rows takes the row furthest from its own."""
    rng = np.random.default_rng(seed)
    different = np.unique(v, axis=0)
    lists = min(lists, len(different))
    centroids = different[rng.choice(len(different), lists, replace=False)].copy()
    for _ in range(rounds):
        close = _closeness(v, centroids)
        own = close.argmax(1)
        sums, sizes = np.zeros_like(centroids), np.bincount(own, minlength=lists)
        np.add.at(sums, own, v)
        full = sizes > 0
        centroids[full] = sums[full] / sizes[full, None]
        far = np.argsort(close[np.arange(len(v)), own] - (v**2).sum(1) / 2, kind="stable")
        centroids[~full] = v[far[: int((~full).sum())]]
        if cosine:
            centroids = _unit(centroids)
    return centroids


def probes_for(v: np.ndarray, centroids: np.ndarray, cosine: bool) -> int:
    """How many lists find RECALL of the AMONG nearest of v's first TRIED rows among v."""
    asked = v[:TRIED]
    score = near.scores(v, asked, "cosine" if cosine else "euclidean")
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argsort(-score, axis=1, kind="stable")[:, : min(AMONG, max(len(v) - 1, 0))]
    lists = _closeness(v, centroids).argmax(1)[best]
    place = np.argsort(np.argsort(-_closeness(asked, centroids), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, lists, 1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)]) if len(needed) else 1


@dataclass(frozen=True)
class VectorIndex:
    """rows: list, vec_id, embedding. Tables are as the caller gives them; write() the index where lineage grows."""

    centroids: np.ndarray
    rows: DataFrame
    probes: int
    cosine: bool = True

    @property
    def length(self) -> int:
        return self.centroids.shape[1]

    @classmethod
    def build(cls, vectors: DataFrame, lists: int | None = None, cosine: bool = True, sample_rows: int = SAMPLE_ROWS, seed: int = 0) -> VectorIndex:
        """The index of all vectors (vec_id, embedding) of the length that the first has; null ones and others have no place in it.

        lists: the square root of the number of rows, if the sample has eight
        rows or more for each.
        """
        length = near.length_of(vectors)
        if not length:
            return cls(np.zeros((1, 1)), vectors.select(F.lit(0).alias("list"), "vec_id", "embedding").limit(0), 1, cosine)
        usable = near.usable(vectors, length)
        v = _sample(usable, min(sample_rows, SAMPLE_BYTES // (8 * length)), seed)
        v = _unit(v) if cosine else v
        lists = lists or max(1, min(int(np.sqrt(usable.count())), len(v) // 8))
        centroids = fitted(v, lists, cosine, seed)
        return cls(centroids, _assigned(usable, centroids, np.arange(len(centroids)), cosine), probes_for(v, centroids, cosine), cosine)

    def add(self, vectors: DataFrame) -> VectorIndex:
        """With these vectors, in place of such as have their ids."""
        new = near.usable(vectors, self.length)
        rows = self.remove(new).rows.unionByName(_assigned(new, self.centroids, np.arange(len(self.centroids)), self.cosine))
        return replace(self, rows=rows)

    def remove(self, ids: DataFrame) -> VectorIndex:
        return replace(self, rows=self.rows.join(ids.select("vec_id").distinct(), "vec_id", "left_anti").select("list", "vec_id", "embedding"))

    def sizes(self) -> np.ndarray:
        """Rows of each list: one number a list comes to the driver."""
        out = np.zeros(len(self.centroids), np.int64)
        got = self.rows.groupBy("list").agg(F.count(F.lit(1)).alias("n")).toArrow()
        out[got["list"].to_numpy()] = got["n"].to_numpy()
        return out

    def rebalanced(self, times: float = 2.0, sample_rows: int = SAMPLE_ROWS, seed: int = 0) -> VectorIndex:
        """Lists of more than `times` the mean are split around new centroids, fitted on samples of theirs; rows of other lists stay where they are.

        A list of equal vectors can't be split, nor need it be: tasks read parts of a list.
        """
        sizes = self.sizes()
        mean = max(1.0, sizes.sum() / max(1, int((sizes > 0).sum())))
        large = np.flatnonzero(sizes > times * mean)
        centroids, rows = self.centroids, self.rows.where(~F.col("list").isin(large.tolist()))
        sample_rows = min(sample_rows, SAMPLE_BYTES // (8 * self.length))
        for number in large.tolist():
            own = self.rows.where(F.col("list") == number)
            v = _sample(own, max(1, sample_rows // len(large)), seed)
            new = fitted(_unit(v) if self.cosine else v, int(np.ceil(sizes[number] / mean)), self.cosine, seed)
            numbers = np.r_[number, np.arange(len(centroids), len(centroids) + len(new) - 1)]
            centroids = np.r_[centroids, new[1:]]
            centroids[number] = new[0]
            rows = rows.unionByName(_assigned(own, new, numbers, self.cosine))
        probes = min(len(centroids), -(-self.probes * len(centroids) // len(self.centroids)))
        return replace(self, centroids=centroids, rows=rows, probes=probes)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, most: int = near.SMALL_BYTES) -> DataFrame:
        """(query_id, id, score, place from 1) of the k nearest that the `probes` nearest lists of each query (vec_id, embedding) hold."""
        metric = "cosine" if self.cosine else "euclidean"
        centroids, cosine, probes = self.centroids, self.cosine, min(probes or self.probes, len(self.centroids))

        def lists_of(q: np.ndarray) -> np.ndarray:
            close = _closeness(_unit(q) if cosine else q, centroids)
            return np.argsort(-close, axis=1, kind="stable")[:, :probes]

        q = near.usable(queries, self.length)
        sent = near.small(q, self.length, most)
        if sent is not None:
            query_ids, q_matrix = sent
            probed = lists_of(q_matrix)
            wanted = np.unique(probed)

            def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                best = near.Best(query_ids, q_matrix, metric, k, None)
                for batch in batches:
                    own = batch.column("list").to_numpy()
                    for number in np.unique(own):
                        some = batch.filter(pa.array(own == number))
                        best.see(some.column("vec_id").to_numpy(), near.matrix(some.column("embedding")), np.flatnonzero((probed == number).any(1)))
                yield best.found()

            rows = self.rows.where(F.col("list").isin(wanted.tolist())) if len(wanted) < len(centroids) else self.rows
            return near.k_nearest(rows.select("list", F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(scan, near.FOUND), k)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = lists_of(near.matrix(batch.column("embedding")))
                at = pa.array(np.repeat(np.arange(len(batch)), lists.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(lists.ravel(), pa.int32()), batch.column("vec_id").take(at), batch.column("embedding").take(at)], names=["list", "vec_id", "embedding"])

        columns = (F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        routed = q.select(*columns).mapInArrow(route, "list int, vec_id long, embedding array<double>")
        # a list's rows and queries in parts of bounded size; one row a list each
        parts = lambda df, rows, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / rows).alias(name))
        shape = F.broadcast(parts(self.rows, near.SLOT_ROWS, "slots").join(parts(routed, near.CHUNK_ROWS, "chunks"), "list"))
        own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = self.rows.select("list", *columns).join(shape, "list").select("list", "vec_id", "embedding", own("slots").alias("slot"), every("chunks").alias("chunk"))
        right = routed.join(shape, "list").select("list", "vec_id", "embedding", own("chunks").alias("chunk"), every("slots").alias("slot"))
        keys = ("list", "slot", "chunk")
        return near.k_nearest(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: near._met(a, b, metric, k, None), near.FOUND), k)

    def exact(self, queries: DataFrame, k: int) -> DataFrame:
        """The same from all rows of the index."""
        return near.nearest(self.rows.select("vec_id", "embedding"), near.usable(queries, self.length), k, "cosine" if self.cosine else "euclidean")

    def write(self, path: str) -> None:
        """Rows in folders by list, so that a search reads its lists' files alone, and the centroids beside them."""
        spark = self.rows.sparkSession
        self.rows.repartition("list", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
        head = [(i, c.tolist(), self.probes, self.cosine) for i, c in enumerate(self.centroids)]
        spark.createDataFrame(head, "list int, centroid array<double>, probes int, cosine boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")

    @classmethod
    def read(cls, spark, path: str) -> VectorIndex:
        head = spark.read.parquet(f"{path}/lists").orderBy("list").toArrow()
        rows = spark.read.parquet(f"{path}/rows").select("list", "vec_id", "embedding")
        return cls(near.matrix(head["centroid"].combine_chunks()), rows, head["probes"][0].as_py(), head["cosine"][0].as_py())


def _sample(vectors: DataFrame, rows: int, seed: int) -> np.ndarray:
    """The rows that a hash of the id puts first, `rows` at most."""
    some = vectors.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(rows).select("embedding").toArrow()
    return near.matrix(some["embedding"].combine_chunks())


def _assigned(vectors: DataFrame, centroids: np.ndarray, numbers: np.ndarray, cosine: bool) -> DataFrame:
    """list, vec_id, embedding: each row in the list of its nearest centroid."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = near.matrix(batch.column("embedding"))
            lists = numbers[_closeness(_unit(v) if cosine else v, centroids).argmax(1)] if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), batch.column("vec_id"), batch.column("embedding")], names=["list", "vec_id", "embedding"])

    rows = vectors.select("vec_id", "embedding")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(assign, f"list int, vec_id {kinds['vec_id']}, embedding {kinds['embedding']}")
