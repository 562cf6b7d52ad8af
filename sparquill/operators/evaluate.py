"""Retrieval, answer and text metrics."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import common_length, let, sentences, set_jaccard, sum_of, syllables, word_grams, words


def retrieval_metrics(judged: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """Per query: precision, recall, F1, average precision, reciprocal rank, NDCG and hits at k.

    judged: query_id, rank (from 0), relevant (0 or 1); totals: query_id,
    total_relevant. Each query of totals has its row, with zeros if nothing was
    found for it.
    """
    top = judged.where(F.col("rank") < k)
    from pyspark.sql import Window

    seen = F.sum("relevant").over(Window.partitionBy("query_id").orderBy("rank"))
    rows = top.withColumn("seen", seen)
    agg = rows.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("relevant").alias("hits"), F.sum(F.col("relevant") * F.col("seen") / (F.col("rank") + 1)).alias("ap"),
        F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"), F.sum(F.col("relevant") / F.log2(F.col("rank") + 2)).alias("dcg"),
    )
    x = agg.join(totals, "query_id", "right").fillna(0, ["n", "hits"]).fillna(0.0, ["ap", "dcg"])
    ideal = sum_of(F.transform(F.sequence(F.lit(1), F.least("total_relevant", F.lit(k))), lambda i: 1 / F.log2(i + 1)))
    precision = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.least("n", F.lit(k))), F.lit(0.0))
    recall = F.when(F.col("total_relevant") == 0, 1.0).otherwise(F.col("hits") / F.col("total_relevant"))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return x.select(
        "query_id", F.round(precision, 6).alias("precision_at_k"), F.round(recall, 6).alias("recall_at_k"), F.round(f1, 6).alias("f1_at_k"),
        F.round(F.coalesce(F.try_divide("ap", "total_relevant"), F.lit(0.0)), 6).alias("average_precision"),
        F.round(F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)), 6).alias("reciprocal_rank"),
        F.round(F.when(F.col("total_relevant") > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg_at_k"), (F.col("hits") > 0).cast("int").alias("hit"),
    )


def readability(text: Column) -> Column:
    """Flesch ease within 0 and 100; the parts between full stops count as sentences, the last empty one, too."""
    w = words(text)
    parts = F.size(F.split(text, "\\."))
    rate = let(w, lambda x: sum_of(F.transform(x, lambda y: syllables(y).cast("double"))) / F.size(x))
    return F.when(F.size(w) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 206.835 - 1.015 * F.size(w) / parts - 84.6 * rate)))


def lexical_diversity(text: Column) -> Column:
    w = words(text)
    return F.coalesce(F.try_divide(F.size(F.array_distinct(w)).cast("double"), F.size(w)), F.lit(0.0))


def coherence(text: Column) -> Column:
    """Mean Jaccard of the words of neighbouring sentences; 1 with fewer than two."""

    def mean(s: Column) -> Column:
        pairs = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: set_jaccard(words(a), words(b)))
        return sum_of(pairs) / (F.size(s) - 1)

    return let(sentences(text), lambda s: F.when(F.size(s) < 2, 1.0).otherwise(mean(s)))


def term_share(text: Column, terms: tuple[str, ...]) -> Column:
    """Share of the words that contain one of the terms."""
    w = words(F.lower(text))
    hits = F.filter(w, lambda x: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(x, t)))
    return F.coalesce(F.try_divide(F.size(hits).cast("double"), F.size(w)), F.lit(0.0))


# What marks a word as toxic when a word contains it.
TOXIC_TERMS = ("hate", "stupid", "idiot", "kill", "die")


def text_quality(docs: DataFrame) -> DataFrame:
    """Readability, diversity, coherence and toxicity of every document, as the functions above have them.

    Words are split once, sentences' word sets made once, and what only counts,
    syllables and toxic words, is counted over the whole text: a run of vowels
    never reaches beyond a word, a word without one has a syllable all the same,
    and from its first toxic part on the rest of a word is passed over.
    """
    t, low, w, n = F.col("text"), F.col("low"), F.col("w"), F.size("w")
    count = lambda pattern: F.size(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)))
    parts = F.char_length(t) - F.char_length(F.replace(t, F.lit("."), F.lit(""))) + 1
    x = docs.select("doc_id", "text", F.lower(t).alias("low"), words(t).alias("w"), F.transform(sentences(t), lambda s: F.array_distinct(words(s))).alias("sets"))
    spoken = count("[aeiouy]+") + count(r"(?<!\S)[^aeiouy\s]++(?!\S)")
    ease = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 206.835 - 1.015 * n / parts - 84.6 * (spoken / n))))
    m = F.size("sets")

    def likeness(one: Column, two: Column) -> Column:
        return let(F.size(F.array_intersect(one, two)), lambda both: F.coalesce(F.try_divide(both.cast("double"), F.size(one) + F.size(two) - both), F.lit(0.0)))

    linked = F.when(m < 2, 1.0).otherwise(sum_of(F.zip_with(F.slice("sets", 1, F.greatest(m - 1, F.lit(0))), F.slice("sets", 2, F.greatest(m - 1, F.lit(0))), likeness)) / (m - 1))
    toxic = count("(?:" + "|".join(TOXIC_TERMS) + r")\S*+")
    return x.select(
        "doc_id", F.round(ease, 6).alias("readability"), F.round(F.coalesce(F.try_divide(F.size(F.array_distinct(w)).cast("double"), n), F.lit(0.0)), 6).alias("lexical_diversity"),
        F.round(linked, 6).alias("coherence"), F.round(F.coalesce(F.try_divide(toxic.cast("double"), n), F.lit(0.0)), 6).alias("toxicity"),
    )


def answer_metrics(turns: DataFrame) -> DataFrame:
    """Faithfulness, relevancy and context precision of answers: query, context, answer per id."""
    q, c, a = (F.array_distinct(words(F.lower(F.col(k)))) for k in ("query", "context", "answer"))
    share = lambda x, y: F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(x)), F.lit(0.0))
    return turns.select(
        "conv_id", "turn", F.round(share(a, c), 6).alias("faithfulness"), F.round(set_jaccard(q, a), 6).alias("answer_relevancy"), F.round(set_jaccard(q, c), 6).alias("context_relevancy"),
        F.round(0.6 * share(q, a) + 0.4 * share(c, a), 6).alias("relevance"),
    )


# Words that a claim without proof is made with, and that join sentences.
BIASED_TERMS = ("always", "never", "all", "none", "everyone", "nobody", "obviously", "clearly", "definitely", "certainly")


def _share(part: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), of), F.lit(0.0))


def text_cosine(a: Column, b: Column) -> Column:
    """Cosine of the counts of two word lists; 0 if one is empty."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x)).cast("double")
    norm = lambda xs: F.sqrt(sum_of(F.transform(F.array_distinct(xs), lambda x: count(xs, x) * count(xs, x))))
    return F.coalesce(F.try_divide(sum_of(F.transform(F.array_intersect(a, b), lambda x: count(a, x) * count(b, x))), norm(a) * norm(b)), F.lit(0.0))


def bleu(candidate: Column, reference: Column, n: int) -> Column:
    """Share of the candidate's n-grams that the reference has, not clipped."""
    return let(word_grams(reference, n), lambda r: let(word_grams(candidate, n), lambda c: _share(F.size(F.filter(c, lambda g: F.array_contains(r, g))), F.size(c))))


def rouge_l(candidate: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of words; 1 if both are empty."""

    def f1(n: Column) -> Column:
        p, r = _share(n, F.size(candidate)), _share(n, F.size(reference))
        return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))

    return F.when((F.size(candidate) == 0) & (F.size(reference) == 0), 1.0).otherwise(let(common_length(candidate, reference), f1))


def entropy_rate(w: Column) -> Column:
    """exp(entropy of the words / number of different ones)."""
    n = F.size(w).cast("double")
    kinds = F.array_distinct(w)
    p = lambda x: F.size(F.filter(w, lambda y: y == x)) / n
    return F.when(F.size(w) > 0, F.exp(-sum_of(F.transform(kinds, lambda x: p(x) * F.log(p(x)))) / F.size(kinds)))


def _longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, the table's rows as bits of one number."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        if here := row & places.get(y, 0):
            row = (row + here | row - here) & full
    return len(a) - row.bit_count()


def _text_pair(a: list[str] | None, b: list[str] | None) -> tuple[float, float, float, int | None, float | None]:
    """Cosine, BLEU of two words, ROUGE-L, longest common subsequence and entropy rate, as the column functions above have them."""
    mine = Counter(a or ())
    rate = math.exp(-sum(n / len(a) * math.log(n / len(a)) for n in mine.values()) / len(mine)) if mine else None
    if a is None or b is None:
        return 0.0, 0.0, 0.0, None, rate
    theirs = Counter(b)
    norms = math.sqrt(sum(n * n for n in mine.values())) * math.sqrt(sum(n * n for n in theirs.values()))
    cosine = sum(n * theirs[w] for w, n in mine.items() if w in theirs) / norms if norms else 0.0
    grams = set(itertools.pairwise(b))
    pairs = max(len(a) - 1, 0)
    common = _longest_common(a, b)
    p, r = (common / len(x) if x else 0.0 for x in (a, b))
    return cosine, sum(g in grams for g in itertools.pairwise(a)) / pairs if pairs else 0.0, 1.0 if not a and not b else 2 * p * r / (p + r) if common else 0.0, common, rate


def _text_pairs(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    kinds = {"cosine": pa.float64(), "bleu_2": pa.float64(), "rouge_l": pa.float64(), "common": pa.int64(), "entropy_rate": pa.float64()}
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            batch = whole.slice(at, rows)
            found = zip(*map(_text_pair, batch.column("wa").to_pylist(), batch.column("wb").to_pylist()), strict=True)
            ids = batch.drop_columns(["wa", "wb"])
            yield pa.RecordBatch.from_arrays([*ids.columns, *(pa.array(c, k) for c, k in zip(found, kinds.values(), strict=True))], names=[*ids.schema.names, *kinds])


def pair_metrics(pairs: DataFrame, ids: list[str]) -> DataFrame:
    """Cosine, BLEU of two words, ROUGE-L and entropy rate of texts a (candidate) and b (reference)."""
    x = pairs.select(*ids, words(F.col("a")).alias("wa"), words(F.col("b")).alias("wb"))
    kinds = StructType([x.schema[k] for k in ids])
    for name, kind in (("cosine", "double"), ("bleu_2", "double"), ("rouge_l", "double"), ("common", "long"), ("entropy_rate", "double")):
        kinds.add(name, kind)
    rounded = (F.round(k, 6).alias(k) if k != "common" else F.col(k) for k in ("cosine", "bleu_2", "rouge_l", "common", "entropy_rate"))
    return x.mapInArrow(_text_pairs, kinds).select(*ids, *rounded)


def answer_quality(rows: DataFrame, ids: list[str]) -> DataFrame:
    """Metrics of answers against a truth, a context and a question: columns query, context, truth, answer."""
    x = rows.select(*ids, "answer", *(F.array_distinct(words(F.lower(F.col(k)))).alias(k[0]) for k in ("query", "context", "truth")), F.array_distinct(words(F.lower("answer"))).alias("a"), F.split("truth", "\\.").alias("parts"))
    inter = lambda x, y: F.size(F.array_intersect(x, y))
    a, c, q, t = (F.col(k) for k in ("a", "c", "q", "t"))
    supported = F.filter("parts", lambda s: let(words(F.lower(s)), lambda w: (F.size(w) > 0) & (_share(F.size(F.filter(w, lambda z: F.array_contains(c, z))), F.size(w)) >= 0.7)))
    recall = _share(inter(a, t), F.size(t))
    return x.select(
        *ids, F.round(_share(F.size(supported), F.size("parts")), 6).alias("context_recall"), F.round(_share(inter(q, c), F.size(q)), 6).alias("query_cover"), (_share(inter(q, c), F.size(q)) >= 0.5).cast("int").alias("context_precision"),
        F.round(set_jaccard(a, t), 6).alias("similarity"), F.round(F.least(0.75 * recall + 0.25 * set_jaccard(a, t), F.lit(1.0)), 6).alias("correctness"), F.round(_share(inter(a, c), F.size(a)), 6).alias("factual"),
    )


def writing(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Fluency, diversity and bias of every text."""
    t = F.col("text")
    x = docs.select(id_column, "text", words(t).alias("w"), F.split(t, "\\.").alias("s"))
    w, n = F.col("w"), F.size("w")
    per = F.coalesce(F.try_divide(n.cast("double"), F.size("s")), F.lit(0.0))
    marked = t.rlike("[.!?]") & t.rlike("\\p{Lu}")
    variety = _share(F.size(F.array_distinct(w)), n)
    spoken = 0.4 * F.when((per >= 5) & (per <= 25), 1.0).otherwise(0.7) + 0.3 * F.when(marked, 1.0).otherwise(0.6) + 0.3 * variety
    fluency = F.when(t != "", spoken).otherwise(0.0)
    return x.select(id_column, F.round(fluency, 6).alias("fluency"), F.round(variety, 6).alias("variety"), F.round(term_share(t, BIASED_TERMS), 6).alias("bias"))


def repetition(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Diversity: the mean of type by token and of 1 less 0.3 for each repeat of the commonest word, as words stand; 0 for empty texts and nulls."""
    rows = docs.select(id_column, (F.coalesce("text", F.lit("")) != "").alias("text"), F.explode_outer(words(F.col("text"))).alias("w")).groupBy(id_column, "text", "w").agg(F.count(F.lit(1)).alias("n"))
    said = F.col("w").isNotNull()
    g = rows.groupBy(id_column).agg(F.count("w").alias("kinds"), F.sum(F.when(said, F.col("n"))).alias("total"), F.max(F.when(said, F.col("n"))).alias("most"), F.max("text").alias("text"))
    repeats = F.greatest(F.lit(0.0), 1 - 0.3 * (F.coalesce("most", F.lit(1)) - 1))
    diversity = (F.coalesce(F.try_divide("kinds", "total"), F.lit(0.0)) + repeats) / 2
    return g.select(id_column, F.round(F.when(F.col("text"), diversity).otherwise(0.0), 6).alias("diversity"))


def system_metrics(runs: DataFrame, most_ms: float = 2000.0, least_rate: float = 10.0, most_errors: float = 5.0) -> DataFrame:
    """Of requests (kind, ms, failed): latency, rate, errors, consistency, and scores between 0 and 1 for each."""
    g = runs.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean_ms"), F.stddev_pop("ms").alias("sd"), F.sum("ms").alias("total"), F.avg(F.col("failed").cast("double")).alias("failed"))
    rate, failed = F.col("n") * 1000.0 / F.col("total"), 100 * F.col("failed")
    latency = F.when(F.col("mean_ms") <= most_ms, 1 - 0.2 * F.col("mean_ms") / most_ms).otherwise(F.greatest(F.lit(0.0), 0.8 - 0.5 * (F.col("mean_ms") - most_ms) / most_ms))
    throughput = F.when(rate >= least_rate, F.least(rate / least_rate, F.lit(2.0)) / 2).otherwise(rate / least_rate)
    errors = F.when(failed <= most_errors, 1 - failed / 1000).otherwise(F.greatest(F.lit(0.0), 0.9 - 2 * (failed - most_errors) / 100))
    x = g.select("kind", "n", "mean_ms", rate.alias("rate"), (100 * F.col("failed")).alias("errors"), F.greatest(F.lit(0.0), 1 - F.col("sd") / F.col("mean_ms")).alias("consistency"), latency.alias("latency_score"), throughput.alias("rate_score"), errors.alias("error_score"))
    return x.select("kind", "n", *(F.round(k, 6).alias(k) for k in ("mean_ms", "rate", "errors", "consistency", "latency_score", "rate_score", "error_score")))
