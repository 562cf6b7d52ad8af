"""Re-ranking of retrieved candidates by signals of their own."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import set_jaccard, words
from ..plans.rounds import few_rows, settled


def document_quality(text: Column, w: Column | None = None) -> Column:
    """Mean of three bands: bytes, bytes a word, words a part between full stops. w: how many words the text has, if that is known."""
    n, s = F.octet_length(text), F.char_length(text) - F.char_length(F.replace(text, F.lit("."), F.lit(""))) + 1
    w = F.size(words(text)) if w is None else w
    per_word, per_part = n / F.greatest(w, F.lit(1)), w / F.greatest(s, F.lit(1))
    inside = lambda x, low, high: (x > low) & (x < high)
    return (F.when(inside(n, 100, 5000), 1.0).otherwise(0.5) + F.when(inside(per_word, 3, 15), 1.0).otherwise(0.7) + F.when(inside(per_part, 5, 30), 1.0).otherwise(0.8)) / 3


def signals(candidates: DataFrame, query: str) -> DataFrame:
    """(doc_id, signal, value): overlap with the query, quality, and length of each candidate. Texts are split into words once."""
    q = F.array(*map(F.lit, query.split()))
    t, w = F.col("text"), F.col("w")
    values = F.array(
        F.struct(F.lit("overlap").alias("signal"), set_jaccard(w, q).alias("value")), F.struct(F.lit("quality").alias("signal"), document_quality(t, F.size(w)).alias("value")),
        F.struct(F.lit("length").alias("signal"), F.size(w).cast("double").alias("value")),
    )
    return candidates.select("doc_id", "text", words(t).alias("w")).select("doc_id", F.inline(values))


def scaled(values: DataFrame, how: str) -> DataFrame:
    """Each signal over all candidates: min-max, z-score with a sigmoid, or rank.

    The first two gather four numbers a signal; ranks sort a signal's values,
    so they are meant for the candidates of a search. Values are written once:
    what they come from is not read again for these numbers.
    """
    values = settled(values)
    v = F.col("value")
    if how == "rank":
        w = Window.partitionBy("signal")
        return values.withColumn("value", 1 - (F.row_number().over(w.orderBy(F.desc("value"), "doc_id")) - 1) / F.count(F.lit(1)).over(w))
    stats = values.groupBy("signal").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    low, high, mean, sd = map(F.col, ("low", "high", "mean", "sd"))
    out = F.when(high > low, (v - low) / (high - low)).otherwise(v) if how == "min_max" else 1 / (1 + F.exp(-F.when(sd > 0, (v - mean) / sd).otherwise(F.lit(0.0))))
    return values.join(few_rows(stats, 100_000), "signal").withColumn("value", out).select(*values.columns)


def combined(values: DataFrame, weights: dict[str, float], how: str = "weighted_sum") -> DataFrame:
    """One score a candidate, and how far its signals agree: 1 less their population deviation."""
    weight = F.coalesce(*(F.when(F.col("signal") == k, F.lit(float(x))) for k, x in weights.items()), F.lit(1.0 / max(len(weights), 1)))
    x = values.withColumn("w", weight)
    score = {"weighted_sum": F.sum(F.col("w") * F.col("value")), "weighted_average": F.sum(F.col("w") * F.col("value")) / F.sum("w"), "max": F.max("value"), "min": F.min("value")}[how]
    return x.groupBy("doc_id").agg(F.round(score, 6).alias("score"), F.round(1 - F.least(F.stddev_pop("value"), F.lit(1.0)), 6).alias("confidence"))


def token_likeness(a: Column, b: Column) -> Column:
    """1 if equal but for case, 0.7 if one holds the other, else half the Jaccard of their characters."""
    x, y = F.lower(a), F.lower(b)
    return F.when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.7).otherwise(0.5 * set_jaccard(F.split(x, ""), F.split(y, "")))


def _word_pairs(least: float, rows: int = 500, most: int = 500_000):
    """For each row's word lists q and d: sum and number of the likenesses above `least` of all pairs, and the sums of cubes and squares of all.

    Different words meet once and count as often as they stand there. Likenesses
    are kept for later rows, `most` of them, as texts share most of their words.
    """

    def likeness(x: str, y: str) -> float:
        if x in y or y in x:
            return 1.0 if x == y else 0.7
        a, b = set(x), set(y)
        both = len(a & b)
        return 0.5 * (both / (len(a) + len(b) - both))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[str, float]] = {}
        held = 0
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                out = []
                for q, d in zip(batch.column("q").to_pylist(), batch.column("d").to_pylist(), strict=True):
                    if q is None or d is None:
                        out.append((None, None, None, None))
                        continue
                    total = third = second = 0.0
                    hits = 0
                    theirs = list(Counter(d).items())
                    for x, nx in Counter(q).items():
                        of_x = known.setdefault(x, {})
                        for y, ny in theirs:
                            v = of_x.get(y)
                            if v is None:
                                v = of_x[y] = likeness(x, y)
                                held += 1
                            n = nx * ny
                            second += n * v * v
                            third += n * v * v * v
                            if v > least:
                                hits += n
                                total += n * v
                    out.append((total, hits, third, second))
                    if held > most:
                        known, held = {}, 0
                sums = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.float64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
                own = batch.drop_columns(["q", "d"])
                yield pa.RecordBatch.from_arrays([*own.columns, *sums], names=[*own.schema.names, "total", "hits", "third", "second"])

    return run


def cross_scores(pairs: DataFrame, ids: list[str], least: float = 0.3) -> DataFrame:
    """Scores of (query, document) rows by the likeness of their words, as token_likeness() has it: plain, with a wave of the length, and with less for the query's length."""
    q, d = (F.transform(words(F.col(k)), F.lower) for k in ("query", "document"))
    x = pairs.select(*ids, F.octet_length("query").alias("q_bytes"), F.octet_length("document").alias("d_bytes"), q.alias("q"), d.alias("d"))
    x = x.select(*ids, "q_bytes", "d_bytes", F.size("q").alias("nq"), F.size("d").alias("nd"), "q", "d")
    kinds = StructType([f for f in x.schema.fields if f.name not in ("q", "d")]).add("total", "double").add("hits", "long").add("third", "double").add("second", "double")
    x = x.mapInArrow(_word_pairs(least), kinds)
    base = F.try_divide("total", "nq") / (1 + F.col("nd") / 100) + F.when(F.try_divide("hits", "nq") > 0.5, 0.2).otherwise(0.0)
    base = F.least(F.greatest(base, F.lit(0.0)), F.lit(1.0))
    neural = 1 / (1 + F.exp(-4 * F.coalesce(F.try_divide("third", "second"), F.lit(0.0))))
    wave = F.least(base + 0.05 * F.abs(F.sin(F.log10(F.col("d_bytes").cast("double")))), F.lit(1.0))
    small = F.greatest(F.lit(0.0), base - 0.02 * (F.col("q_bytes") % 7) / 7)
    return x.select(*ids, F.round(base, 6).alias("plain"), F.round(wave, 6).alias("wave"), F.round(small, 6).alias("small"), F.round(neural, 6).alias("neural"), F.round(F.least(1.05 * neural, F.lit(1.0)), 6).alias("neural_wide"))


def candidates(found: DataFrame, how: str, value: float = 0.0, batch: int = 16) -> DataFrame:
    """Which rows (id, score) go on: "top" so many, "threshold" this score or more, "adaptive" half a deviation under the mean or more, three batches at most."""
    ordered = found.orderBy(F.desc("score"), "id")
    if how == "top":
        return ordered.limit(int(value))
    if how == "threshold":
        return found.where(F.col("score") >= value)
    stats = found.agg((F.avg("score") - 0.5 * F.stddev_pop("score")).alias("least"))
    return found.join(F.broadcast(stats)).where(F.col("score") >= F.col("least")).drop("least").orderBy(F.desc("score"), "id").limit(3 * batch)  # stats is one row


def freshness(at: Column, as_of: str) -> Column:
    """exp(-hours / 168), a time that is missing counting as 30 days, 1 at most."""
    hours = F.coalesce((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(at)) / 3600.0, F.lit(720.0))
    return F.least(F.exp(-F.floor(hours) / 168.0), F.lit(1.0))


def learned_scores(features: Column, trees: int, how: str = "trees") -> Column:
    """Score of an array of features by the stand-in models: a sum over trees of 0.01 * mean(f_i * sin(0.1 + 0.01 * (tree + i))), or the mean, through a sigmoid."""
    import math

    n = F.size(features)
    if how == "mean":
        total = F.aggregate(features, F.lit(0.0), lambda s, v: s + v) / n
    else:  # the trees' weights of each place summed up beforehand
        weights = F.array(*[F.lit(0.01 * sum(math.sin(0.1 + 0.01 * (t + i)) for t in range(trees))) for i in range(16)])
        total = F.aggregate(F.zip_with(features, F.slice(weights, 1, n), lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v) / n
    return 1 / (1 + F.exp(-total))


def within_row(features: Column) -> Column:
    """Min-max over the features of one row; as they are if all are alike."""
    low, high = F.array_min(features), F.array_max(features)
    return F.when(high > low, F.transform(features, lambda v: (v - low) / (high - low))).otherwise(features)


def learning_features(docs: DataFrame, query: str, trees: int = 100) -> DataFrame:
    """Length, relative length, matches and coverage of query terms, and what the models make of them."""
    terms = sorted(set(query.lower().split()))
    x = docs.select("doc_id", words(F.lower("text")).alias("w"))
    x = x.select("doc_id", F.size("w").alias("n"), *(F.size(F.array_intersect("w", F.array(F.lit(t)))).alias(f"has{i}") for i, t in enumerate(terms)), F.size(F.filter("w", lambda v: v.isin(*terms))).alias("hits"))
    mean = x.agg(F.avg("n").alias("mean"))
    x = x.join(F.broadcast(mean))  # one row
    tf = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("n")), F.lit(0.0))
    cover = sum((F.col(f"has{i}") for i in range(len(terms))), F.lit(0)) / float(len(terms))
    features = F.array(F.col("n").cast("double"), F.col("n") / F.col("mean"), tf, cover)
    return x.select("doc_id", "n", F.round(F.col("n") / F.col("mean"), 6).alias("relative"), F.round(tf, 6).alias("tf"), F.round(cover, 6).alias("coverage"), F.round(learned_scores(within_row(features), trees), 6).alias("trees"), F.round(learned_scores(within_row(features), trees, "mean"), 6).alias("mean_model"))
