"""Keyword and vector search, and fusion of ranked lists.

Rankings are total: by rounded score, then id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, alphanumerics, let, stem
from ..plans.rounds import settled
from .nearest import nearest


def term_list(text: Column) -> Column:
    """The terms of a text: lower case, no stop words, stemmed."""
    return F.transform(F.filter(alphanumerics(text), lambda w: ~w.isin(*sorted(set(STOP_WORDS)))), stem)


def terms(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, term), a row for each token."""
    return docs.select(F.col(id_column).alias("id"), F.explode(term_list(F.col(text))).alias("term"))


def term_shares(docs: DataFrame) -> DataFrame:
    """(term, id, tf): each term's share of its document's terms."""
    counted = docs.select(F.col("doc_id").alias("id"), term_list(F.col("text")).alias("t")).select("id", F.size("t").alias("len"), F.explode("t").alias("term"))
    return counted.groupBy("term", "id").agg((F.count(F.lit(1)) / F.max("len")).alias("tf"))


def postings(docs: DataFrame) -> DataFrame:
    """(term, id, tf, df): the inverted index, term_shares() with how many documents have the term."""
    tf = term_shares(docs)
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return tf.join(df, "term")


def term_statistics(docs: DataFrame) -> DataFrame:
    """total_docs, unique_terms, avg_length of the index."""
    total = docs.agg(F.count(F.lit(1)).alias("total_docs"))
    t = terms(docs).agg(F.countDistinct("term").alias("unique_terms"), F.count(F.lit(1)).alias("n"))
    return total.join(F.broadcast(t)).select("total_docs", "unique_terms", F.round(F.col("n") / F.col("total_docs"), 6).alias("avg_length"))  # one row each


def bm25(docs: DataFrame, query: list[str], limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The best documents for query terms: tf is a share of the document's terms, the score a mean over the query.

    Terms are counted within each row, once; the counts are written, a few
    numbers a document, and only one row of totals is gathered from them.
    """

    def counts(t: Column) -> Column:
        times = lambda q: F.size(F.filter(t, lambda x: x == q))
        return F.struct(F.size(t).alias("len"), *(times(q).alias(f"n{i}") for i, q in enumerate(query)))

    lengths = settled(docs.select(F.col("doc_id").alias("id"), let(term_list(F.col("text")), counts).alias("c")).select("id", "c.*"))
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avgdl"), *(F.sum((F.col(f"n{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(query))))

    def part(i: int) -> Column:
        tf = F.col(f"n{i}") / F.col("len")
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))

    score = reduce(lambda x, y: x + y, [part(i) for i in range(len(query))]) / len(query)
    hits = lengths.where(reduce(lambda x, y: x | y, [F.col(f"n{i}") > 0 for i in range(len(query))]))
    scored = hits.join(F.broadcast(totals)).select("id", F.round(score, 6).alias("score"))  # totals is one row
    return ranked(scored, limit)


def ranked(scored: DataFrame, limit: int) -> DataFrame:
    """The top rows with a rank from 0: a bounded list, so that one task may number it."""
    top = scored.orderBy(F.desc("score"), "id").limit(limit)
    return top.select("id", "score", (F.row_number().over(Window.orderBy(F.desc("score"), "id")) - 1).alias("rank"))


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", min_score: float | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the k most alike of all vectors for each query; both vec_id, embedding."""
    return nearest(vectors, queries, k, metric, min_score).select("query_id", "id", "score", (F.col("place") - 1).alias("rank"))


def reciprocal_rank_fusion(lists: list[DataFrame], limit: int, k: int = 60) -> DataFrame:
    """Fused by the sum of 1 / (k + rank + 1), over the greatest sum."""
    every = reduce(DataFrame.unionByName, [x.select("id", (1 / (k + F.col("rank") + 1)).alias("part")) for x in lists])
    sums = every.groupBy("id").agg(F.sum("part").alias("raw"))
    best = sums.agg(F.max("raw").alias("best"))
    return ranked(sums.join(F.broadcast(best)).select("id", F.round(F.col("raw") / F.col("best"), 6).alias("score")), limit)


def weighted_fusion(lists: list[DataFrame], weights: list[float], limit: int, scaling: str = "min_max") -> DataFrame:
    """Fused by the weighted sum of scores that are first scaled within their list."""
    total, parts = sum(weights), []
    for x, w in zip(lists, weights, strict=True):
        stats = x.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
        scaled = {
            "min_max": F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.col("score")),
            "z_score": F.when(F.col("sd") > 0, (F.col("score") - F.col("mean")) / F.col("sd")).otherwise(F.col("score")),
            "none": F.col("score"),
        }[scaling]
        parts.append(x.join(F.broadcast(stats)).select("id", (scaled * (w / total if total > 0 else w)).alias("part")))
    every = reduce(DataFrame.unionByName, parts)
    return ranked(every.groupBy("id").agg(F.round(F.sum("part"), 6).alias("score")), limit)


def learned_fusion(lists: list[DataFrame], weights: list[float], limit: int) -> DataFrame:
    """Fused by a weighted sum of features: of each list 1 / (rank + 1), score and share of the list behind it; of each two, product, difference and greater of their scores."""
    every = None
    for i, x in enumerate(lists):
        size = x.agg(F.count(F.lit(1)).alias(f"size{i}"))
        own = x.join(F.broadcast(size)).select("id", (1 / (F.col("rank") + 1)).alias(f"r{i}"), F.col("score").alias(f"s{i}"), ((F.col(f"size{i}") - F.col("rank")) / F.col(f"size{i}")).alias(f"p{i}"))  # size is one row
        every = own if every is None else every.join(own, "id", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    features = [zero(f"{c}{i}") for i in range(len(lists)) for c in "rsp"]
    for i in range(len(lists)):
        for j in range(i + 1, len(lists)):
            a, b = zero(f"s{i}"), zero(f"s{j}")
            features += [a * b, F.abs(a - b), F.greatest(a, b)]
    score = reduce(lambda x, y: x + y, [f * float(w) for f, w in zip(features, weights, strict=False)])
    return ranked(every.select("id", F.round(score, 6).alias("score")), limit)


def combined(semantic: DataFrame, keyword: DataFrame, limit: int, share: float = 0.7) -> DataFrame:
    """share of the semantic score and the rest of the keyword score, over documents that either has."""
    x = semantic.select("id", F.col("score").alias("a")).join(keyword.select("id", F.col("score").alias("b")), "id", "full_outer")
    return ranked(x.select("id", F.round(share * F.coalesce("a", F.lit(0.0)) + (1 - share) * F.coalesce("b", F.lit(0.0)), 6).alias("score")), limit)


def boosted(found: DataFrame, as_of: str, semantic: float, metadata: float, recency: float, quality: float) -> DataFrame:
    """Scores with what metadata, age and length add, 1 at most; found: id, score, meta (map), created_at, text."""
    age = F.datediff(F.lit(as_of).cast("timestamp"), F.col("created_at"))
    n = F.octet_length("text")
    parts = F.col("score") * semantic + F.when(F.size("meta") > 0, 0.1 * metadata).otherwise(0.0) + F.coalesce(F.exp(-age / 30.0) * recency, F.lit(0.0)) + F.when((n > 100) & (n < 2000), 0.05 * quality).otherwise(0.0)
    return found.select("id", F.round(F.least(parts, F.lit(1.0)), 6).alias("score"))


def matching(rows: DataFrame, filters: dict[str, str], meta: str = "meta") -> DataFrame:
    """Rows whose metadata has every key with just that value; a missing key rejects."""
    return rows.where(reduce(lambda x, y: x & y, [F.coalesce(F.col(meta)[k] == v, F.lit(False)) for k, v in filters.items()], F.lit(True)))
