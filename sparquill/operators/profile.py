"""Profiles of tables and pairs: column statistics, likeness of texts, entities, quantised vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, set_jaccard, sum_of, words
from ..functions.vectors import doubles


def columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows, nulls, distinct values, least and greatest as text, of each column: one pass, a row a column."""
    aggs = []
    for c in names:
        text = F.col(c).cast("string")
        aggs.append(F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(c).isNull().cast("long")).alias("n_nulls"), F.countDistinct(c).alias("n_distinct"), F.min(text).alias("low"), F.max(text).alias("high")).alias(c))
    return df.agg(*aggs).select(F.inline(F.array(*names)))


def gram_counts(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, kinds): how many runs of n characters char_grams() has of each text, and how many different ones; texts without any have no row."""

    def counted(raw: bytes | None) -> tuple[int, int]:
        chars = np.frombuffer((raw or b"").decode().encode("utf-32-le"), "<u4").astype(np.int64)
        rows = len(chars) - n + 1
        if rows < 1:
            return 0, 0
        key, solid = chars[:rows], chars[:rows] != 32
        for j in range(1, n):
            if j > 2:  # three characters fill a key, more of them take the places of those before
                key = np.unique(key, return_inverse=True)[1]
            key = key << 21 | chars[j : j + rows]
            solid = solid | (chars[j : j + rows] != 32)
        key = np.sort(key[solid])
        return len(key), int(np.count_nonzero(np.diff(key))) + bool(len(key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted(raw.as_py()) for raw in batch.column("raw")]
            each = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(each[:, 0]), pa.array(each[:, 1])], names=["doc_id", "n", "kinds"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, kinds long").where("n > 0")


def column_type(value: Column) -> Column:
    """What a text looks like: number, date, boolean or string."""
    v = F.trim(value)
    return F.when(v.isNull() | (v == ""), "string").when(v.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$"), "number").when(v.rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}"), "date").when(F.lower(v).isin("true", "false", "yes", "no"), "boolean").otherwise("string")


def pair_likeness(pairs: DataFrame, ids: list[str]) -> DataFrame:
    """Word Jaccard, edit distance over the longer byte length and unigram precision of texts a and b."""
    a, b = F.col("a"), F.col("b")
    wa, wb = words(a), words(b)
    known = let(wb, lambda y: F.size(F.filter(wa, lambda t: F.array_contains(y, t))).cast("double"))
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return pairs.select(
        *ids, F.round(set_jaccard(wa, wb), 6).alias("jaccard"), F.round(F.coalesce(F.try_divide(F.levenshtein(a, b).cast("double"), longest), F.lit(0.0)), 6).alias("edit"),
        F.round(F.coalesce(F.try_divide(known, F.size(wa)), F.lit(0.0)), 6).alias("bleu_1"),
    )


def quantised(vectors: DataFrame) -> DataFrame:
    """Greatest and mean error of 8-bit scalar quantisation of each vector."""
    v = doubles(F.col("embedding"))

    def error(x: Column) -> Column:
        low, scale = F.array_min(x), (F.array_max(x) - F.array_min(x)) / 255
        back = F.transform(x, lambda e: F.abs(e - (F.when(scale > 0, F.round((e - low) / scale)).otherwise(0.0) * scale + low)))
        return F.struct(F.round(F.array_max(back), 6).alias("max_error"), F.round(sum_of(back) / F.size(x), 6).alias("mean_error"))

    return vectors.select("vec_id", let(v, error).alias("e")).select("vec_id", "e.max_error", "e.mean_error")


def centroids(vectors: DataFrame) -> DataFrame:
    """Size and mean vector length of the clusters that labels name: sums by place, combined before the shuffle."""
    flat = vectors.select("label", F.posexplode("embedding").alias("place", "x"))
    means = flat.groupBy("label", "place").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    return means.groupBy("label").agg(F.max("n").alias("size"), F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("norm"))
