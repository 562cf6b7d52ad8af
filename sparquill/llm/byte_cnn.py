"""Quality classifier: a convolutional network over the bytes of whole texts.

Filters eight bytes wide run over every place of a text; over chunks of 256
places that overlap by 64 each filter's greatest response is kept, squashed,
and the chunks' mean and maximum are combined into one logit. Numpy does the
training and the scoring; the filters are tables of byte by place, so that a
response is a sum of eight table rows.

The network learns from at most `sample` rows of each label, those with the
least hashes of doc_id, whole texts of these in the chunks that scoring pools;
scoring reads all texts, whole, TOGETHER chunks at a time. The driver holds the bytes of the sampled texts
and the responses of TOGETHER chunks at a time. Rows whose label or doc_id is null teach
nothing. Without rows of both labels every score is the share of label 1 (0.5
if there are no labels). Null texts count as empty, and an empty text is
scored as eight zero bytes. Rows keep their doc_id, null or repeated; no rows
give no rows. No column but the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesnp import text_runs

WIDTH, FILTERS, CHUNK, STEP, TOGETHER = 8, 16, 256, 192, 1024


def _chunks(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first place and end of each chunk; a text of n bytes has n + 1 places."""
    places = lengths + 1
    count = np.maximum(1, -(-(places - (CHUNK - STEP)) // STEP))
    row = np.repeat(np.arange(len(lengths)), count)
    number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = number * STEP
    return row, start, np.minimum(start + CHUNK, places[row])


def _padded(data: np.ndarray, lengths: np.ndarray, more: int = 0) -> np.ndarray:
    """The rows of data, WIDTH zero bytes after each, and more of them at the end."""
    out = np.zeros(len(data) + WIDTH * len(lengths) + more, np.uint8)
    at = 0
    for i, n in enumerate(lengths.tolist()):
        out[at + i * WIDTH : at + i * WIDTH + n] = data[at : at + n]
        at += n
    return out


@dataclass
class Network:
    tables: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    mean_weights: np.ndarray
    max_weights: np.ndarray
    offset: float
    brevity: float = 0.0  # weight of 1 / (1 + bytes / 100): few places give low maxima

    def pairs(self) -> list[np.ndarray]:
        """The tables of each two places as one, by both bytes."""
        if not hasattr(self, "_pairs"):
            t = self.tables
            self._pairs = [(t[j + 1][None, :] + t[j][:, None]).reshape(-1, FILTERS) for j in range(0, WIDTH, 2)]
        return self._pairs

    def _pooled(self, padded: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each filter's greatest response in some chunks that follow each other; memory grows with these alone."""
        first, n = start[0], end[-1] - start[0]
        some = padded[first : first + n + WIDTH - 1]
        two = (some[:-1].astype(np.intp) << 8) | some[1:]
        response = self.pairs()[0][two[:n]]
        part = np.empty_like(response)
        for j, table in enumerate(self.pairs()[1:], 1):
            np.take(table, two[2 * j : 2 * j + n], axis=0, out=part, mode="clip")
            response += part
        edges = np.empty(2 * len(start), np.int64)
        edges[0::2], edges[1::2] = start - first, end - first
        return np.maximum.reduceat(response, edges[:-1], axis=0)[0::2]

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of a run of bytes."""
        lengths = np.diff(bounds)
        rows = len(lengths)
        padded = _padded(data, lengths)
        row, start, end = _chunks(lengths)
        base = bounds[:-1][row] + row * WIDTH
        pooled = np.concatenate([self._pooled(padded, (base + start)[i : i + TOGETHER], (base + end)[i : i + TOGETHER]) for i in range(0, len(row), TOGETHER)])
        active = np.tanh(pooled + self.bias)
        firsts = np.searchsorted(row, np.arange(rows))
        count = np.bincount(row, minlength=rows)[:, None]
        mean = np.add.reduceat(active, firsts, axis=0) / count
        most = np.maximum.reduceat(active, firsts, axis=0)
        logit = mean @ self.mean_weights + most @ self.max_weights + self.offset + self.brevity / (1 + lengths / 100)
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))


def constant(share: float) -> Network:
    share = min(max(share, 1e-6), 1 - 1e-6)
    zero = np.zeros(FILTERS, np.float32)
    return Network(np.zeros((WIDTH, 256, FILTERS), np.float32), zero, zero, zero, float(np.log(share / (1 - share))))


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 48, rate: float = 0.01, seed: int = 11) -> Network:
    """Adam on the log loss, both labels weighted alike."""
    rng = np.random.default_rng(seed)
    shapes = [(WIDTH, 256, FILTERS), (FILTERS,), (FILTERS,), (FILTERS,), (2,)]
    p = [rng.normal(0, s, shape).astype(np.float32) for s, shape in zip((0.25, 0.01, 0.3, 0.3, 0.01), shapes, strict=True)]
    first, second = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    brief = np.array([1 / (1 + len(x) / 100) for x in texts], np.float32)
    lengths = np.array([len(x) for x in texts], np.int64)
    padded = _padded(np.frombuffer(b"".join(texts), np.uint8), lengths, CHUNK)
    row, start, end = _chunks(lengths)
    base, places = (np.cumsum(lengths) - lengths)[row] + row * WIDTH + start, end - start
    edges = np.searchsorted(row, np.arange(len(texts) + 1))

    def strongest(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place and the size of each filter's greatest response in each chunk."""
        where, size = np.empty((len(pieces), FILTERS), np.int64), np.empty((len(pieces), FILTERS), np.float32)
        for at in range(0, len(pieces), TOGETHER):
            some = pieces[at : at + TOGETHER]
            block = padded[base[some][:, None] + np.arange(CHUNK + WIDTH - 1)]
            response = p[0][0][block[:, :CHUNK]]
            for j in range(1, WIDTH):
                response += p[0][j][block[:, j : j + CHUNK]]
            response[np.arange(CHUNK) >= places[some][:, None]] = -1e9
            best = response.argmax(axis=1)
            where[at : at + TOGETHER] = best
            size[at : at + TOGETHER] = np.take_along_axis(response, best[:, None, :], 1)[:, 0]
        return where, size

    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            pieces = np.concatenate([np.arange(edges[d], edges[d + 1]) for d in some])
            own = np.repeat(np.arange(len(some)), edges[some + 1] - edges[some])
            best, size = strongest(pieces)
            active = np.tanh(size + p[1])
            firsts = np.searchsorted(own, np.arange(len(some)))
            count = np.bincount(own)[:, None]
            mean = np.add.reduceat(active, firsts, axis=0) / count
            most = np.maximum.reduceat(active, firsts, axis=0)
            logit = mean @ p[2] + most @ p[3] + p[4][0] + p[4][1] * brief[some]
            d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[some]) * weight[some] / len(some)).astype(np.float32)
            back = (d[:, None] * p[2] / count)[own] + (d[:, None] * p[3])[own] * (active == most[own])
            back *= 1 - active**2
            grads = [np.zeros_like(p[0]), back.sum(0), mean.T @ d, most.T @ d, np.array([d.sum(), d @ brief[some]], np.float32)]
            place = base[pieces][:, None] + best
            for j in range(WIDTH):
                np.add.at(grads[0][j], (padded[place + j], np.arange(FILTERS)[None, :]), back)
            step += 1
            for i, g in enumerate(grads):
                g = g + 1e-4 * p[i] if i == 0 else g
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                p[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Network(*p[:4], float(p[4][0]), float(p[4][1]))


def held_out(doc_id: Column) -> Column:
    """Rows that no network learns from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2000) -> Network:
    """The network that the labelled rows teach; sample: most rows of each label."""
    own = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = [own.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1)]
    few = F.broadcast(chosen[0].union(chosen[1]))  # 2 * sample rows at most
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(few, "doc_id").select("doc_id", "quality", raw.alias("raw")).toPandas()
    rows["raw"] = rows["raw"].map(bytes)
    rows = rows.sort_values(["doc_id", "raw"])
    if rows["quality"].nunique() < 2:
        return constant(float(rows["quality"].mean()) if len(rows) else 0.5)
    return train(rows["raw"].tolist(), rows["quality"].to_numpy())


def score(docs: DataFrame, network: Network) -> DataFrame:
    """docs, all columns kept, with a score column for the text column at the end."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        parts = [shared.value.scores(data, bounds) for _, data, bounds in text_runs(texts, 1 << 17)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn("score", scored("text"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    rows = score(docs.select(F.col("doc_id").cast("long"), "text"), fit(docs, labels))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose text scores threshold or more, columns as they are."""
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    text = f"c{columns.index('text')}"
    rows = score(plain.withColumn("text", F.col(text)), fit(docs, labels))
    return rows.where(F.col("score") >= threshold).select(*[f"c{i}" for i in range(len(columns))]).toDF(*columns)
