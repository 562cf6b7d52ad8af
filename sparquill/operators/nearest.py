"""Nearest vectors by blocks: tasks set Arrow batches of vectors against all queries at once, as matrices.

Scores are rounded to six places and ties go to the least id, so rankings are
total. Vectors that are null or of another length than the queries have no
score. A vector never answers the query of its own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOUND = "query_id long, id long, score double"
SMALL_BYTES = 8 << 20  # queries that are sent to every task
CHUNK_ROWS, SLOT_ROWS = 2_000, 20_000  # of queries and vectors that meet in one task, beyond that
BLOCK_CELLS = 1 << 20  # scores that a worker holds at a time


def matrix(column: pa.Array) -> np.ndarray:
    """The lists of a column as rows of doubles; all are of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def scores(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """[query, vector]; higher is nearer."""
    if metric in ("cosine", "dot", "clamped"):
        out = q @ v.T
        if metric == "cosine":
            norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)
            out = np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)
        return np.clip(out, 0, 1) if metric == "clamped" else out
    if metric == "euclidean":
        return 1 / (1 + np.sqrt(np.stack([((v - x) ** 2).sum(1) for x in q]))) if len(q) else np.zeros((0, len(v)))
    if metric == "manhattan":
        return 1 / (1 + np.stack([np.abs(v - x).sum(1) for x in q])) if len(q) else np.zeros((0, len(v)))
    raise ValueError(f"unknown metric {metric}")


def k_best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (query, id, score) the k best of each query, by score, then id."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.flatnonzero(np.diff(query, prepend=-1))
    keep = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) < k
    return query[keep], ids[keep], score[keep]


class Best:
    """The k best of each of the queries among the vectors seen so far."""

    def __init__(self, query_ids: np.ndarray, q: np.ndarray, metric: str, k: int, least: float | None):
        self.query_ids, self.q, self.metric, self.k, self.least = query_ids, q, metric, k, least
        self.rows = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def see(self, ids: np.ndarray, v: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Sets vectors against the queries at these places, all of them without places."""
        asked = np.arange(len(self.q)) if asked is None else asked
        if not len(ids) or not len(asked):
            return
        step = max(1, BLOCK_CELLS // len(ids))
        found = [self.rows]
        for a in range(0, len(asked), step):
            some = asked[a : a + step]
            s = np.round(scores(v, self.q[some], self.metric), 6) + 0.0
            ok = (self.query_ids[some][:, None] != ids) & ~np.isnan(s)
            if self.least is not None:
                ok &= s >= self.least
            if len(ids) > self.k:  # only what reaches the k-th place of its row can be among the best
                ok &= s >= np.partition(np.where(ok, s, -np.inf), -self.k, axis=1)[:, -self.k, None]
            row, at = np.nonzero(ok)
            found.append((some[row], ids[at], s[row, at]))
        self.rows = k_best(*(np.concatenate(x) for x in zip(*found, strict=True)), self.k)

    def found(self) -> pa.RecordBatch:
        query, ids, score = self.rows
        return pa.RecordBatch.from_pydict({"query_id": pa.array(self.query_ids[query], pa.int64()), "id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())})


def usable(df: DataFrame, length: int) -> DataFrame:
    return df.where(F.col("vec_id").isNotNull() & (F.size("embedding") == length))


def length_of(queries: DataFrame) -> int:
    """How many numbers a query has; 0 without queries."""
    some = queries.where("embedding is not null").select(F.size("embedding")).first()
    return some[0] if some else 0


def small(queries: DataFrame, length: int, most: int = SMALL_BYTES) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and matrix of the queries, if these take `most` bytes or less."""
    rows = most // (8 * length + 8)
    got = queries.select(F.col("vec_id").cast("long"), "embedding").limit(rows + 1).toArrow()
    if got.num_rows > rows:
        return None
    got = got.combine_chunks()
    return got["vec_id"].to_numpy(), matrix(got["embedding"].combine_chunks())


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", least: float | None = None, most: int = SMALL_BYTES) -> DataFrame:
    """(query_id, id, score, place from 1) of the k nearest of all vectors (vec_id, embedding) for each query (vec_id, embedding).

    Queries of at most `most` bytes go to every task, and vectors don't move.
    More are dealt in chunks to slots of the vectors, so that a task holds a
    bounded number of both.
    """
    length = length_of(queries)
    if not length:
        return k_nearest(vectors.sparkSession.createDataFrame([], FOUND), k)
    v, q = usable(vectors, length), usable(queries, length)
    sent = small(q, length, most)
    if sent is not None:
        query_ids, q_matrix = sent

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(query_ids, q_matrix, metric, k, least)
            for batch in batches:
                best.see(batch.column("vec_id").to_numpy(), matrix(batch.column("embedding")))
            yield best.found()

        found = v.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(scan, FOUND)
    else:
        slots, chunks = (max(1, -(-df.count() // rows)) for df, rows in ((v, SLOT_ROWS), (q, CHUNK_ROWS)))
        dealt = lambda df, name, n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias(name)
        every = lambda name, n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
        columns = (F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        left = v.select(*columns, dealt(v, "slot", slots), every("chunk", chunks)).groupBy("slot", "chunk")
        right = q.select(*columns, dealt(q, "chunk", chunks), every("slot", slots)).groupBy("slot", "chunk")
        found = left.cogroup(right).applyInArrow(lambda a, b: _met(a, b, metric, k, least), FOUND)
    return k_nearest(found, k)


def _met(vectors: pa.Table, queries: pa.Table, metric: str, k: int, least: float | None) -> pa.Table:
    best = Best(queries["vec_id"].to_numpy(), matrix(queries["embedding"].combine_chunks()), metric, k, least)
    best.see(vectors["vec_id"].to_numpy(), matrix(vectors["embedding"].combine_chunks()))
    return pa.Table.from_batches([best.found()])


def k_nearest(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, of those that tasks kept, with their place from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
