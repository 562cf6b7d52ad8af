"""I-Match fingerprints in DataFrame operations alone.

The lexicon holds the terms whose document frequency, as a share of all
documents, lies between `low` and `high`: an inverse document frequency of 3.0
to 5.8 by default. A document's fingerprint hashes its sorted distinct terms
of the lexicon within several random sub-lexicons, at two rates: a document
with 2^L to 2^(L+1) of these terms uses sub-lexicons that keep one term of 2^L
and one of 2^(L+1), so that one or two of its terms fall into each, and texts
that differ in some places still agree in some hashes. Likeness is the share
of equal hashes among those that are not empty in both, at the rates that both
fingerprints have; 0 if there is no such rate.

The lexicon has at most (mean distinct terms of a document) / low terms,
however many documents there are; it is broadcast if it really is as small.

Null texts are empty. A text without terms of the lexicon has a hash of itself
instead, like only its equals. Rows without doc_id are left out; rows
that share a doc_id are ordered by text. The only document is its own next one.
Other columns are not read; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, keyed, pieces_for

SUBSETS, DIGITS, STRIDE = 16, 4, 3
MOST_TERMS = 1_000_000  # of a lexicon (8 bytes each) that is broadcast; a larger one is joined by a shuffle
_SEGMENT = SUBSETS * DIGITS


def term_hashes(text: Column) -> Column:
    """Hashes of the distinct lower-case words, even numbers."""
    words = F.transform(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda x: F.xxhash64(x).bitwiseAND(-2))
    return F.array_remove(F.array_distinct(words), F.xxhash64(F.lit("")).bitwiseAND(-2))


def lexicon(docs: DataFrame, low: float, high: float) -> DataFrame:
    """(term) of the hashed terms in the band."""
    n = docs.count()
    terms = docs.select(F.explode(term_hashes(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(low * n, high * n)).select("term")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spelled(own: Column) -> Column:
    """The hash of a sub-lexicon's terms in digits; zeros if there are none."""
    return F.when(F.size(own) == 0, F.lit("0" * DIGITS)).otherwise(F.lpad(F.hex(F.pmod(F.xxhash64(own), F.lit(16**DIGITS - 1)) + 1), DIGITS, "0"))


def _kept(terms: Column, level: Column, k: Column) -> Column:
    """Terms whose `level` bits from place 1 + STRIDE * k on are clear: the k-th sub-lexicon at that rate."""
    mask = F.call_function("shiftleft", F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, 1 + STRIDE * k)
    return _let(mask, lambda m: F.filter(terms, lambda t: t.bitwiseAND(m) == 0))


def fingerprint(terms: Column, whole: Column) -> Column:
    """Level and two segments; terms: those of the lexicon, distinct; whole: a hash of the text."""

    def spelled(ts: Column) -> Column:
        def at(level: Column) -> Column:
            def both(k: Column) -> Column:  # the rarer sub-lexicon is part of the other
                return _let(_kept(ts, level, k), lambda own: F.struct(_spelled(own).alias("a"), _let(_kept(own, level + 1, k), _spelled).alias("b")))

            pairs = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), both)
            return _let(pairs, lambda p: F.concat(F.lpad(level.cast("string"), 2, "0"), F.array_join(p["a"], ""), F.array_join(p["b"], "")))

        return _let(F.floor(F.log2(F.size(ts))).cast("int"), at)

    return F.when(F.size(terms) == 0, F.concat(F.lit("--"), F.lpad(F.hex(whole), 16, "0"))).otherwise(_let(F.sort_array(terms), spelled))


def _agree(x: Column, y: Column) -> Column:
    """Share of equal hashes among those not empty in both."""
    empty = F.lit("0" * DIGITS)

    def cut(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), (F.length(s) / DIGITS).cast("int") - 1), lambda i: F.substring(s, i * DIGITS + 1, F.lit(DIGITS)))

    def share(pairs: Column) -> Column:
        used = F.filter(pairs, lambda p: (p["a"] != empty) | (p["b"] != empty))
        same = F.filter(pairs, lambda p: (p["a"] != empty) & (p["a"] == p["b"]))
        return F.when(F.size(used) == 0, F.lit(0.0)).otherwise(F.size(same) / F.size(used))

    return _let(F.zip_with(cut(x), cut(y), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), share)


def likeness(x: Column, y: Column) -> Column:
    """0 to 1 for two fingerprints."""
    level_x, level_y = F.substring(x, 1, 2).try_cast("int"), F.substring(y, 1, 2).try_cast("int")
    first, second = (lambda s: F.substring(s, 3, _SEGMENT)), (lambda s: F.substring(s, 3 + _SEGMENT, _SEGMENT))
    return (
        F.when(x == y, F.lit(1.0))
        .when(level_x == level_y, _agree(F.substring(x, 3, 2 * _SEGMENT), F.substring(y, 3, 2 * _SEGMENT)))
        .when(level_y == level_x + 1, _agree(second(x), first(y)))
        .when(level_x == level_y + 1, _agree(first(x), second(y)))
        .otherwise(F.lit(0.0))
    )


def _bucketed(docs: DataFrame, task_bytes: int) -> DataFrame:
    """docs with a bucket that ascends with doc_id and holds about task_bytes."""
    pieces = pieces_for(docs, task_bytes)
    cuts = min(pieces, 256)
    bounds = sorted(set(docs.approxQuantile("doc_id", [i / cuts for i in range(cuts + 1)], 0.2 / cuts))) or [0.0]
    within = -(-pieces // cuts)  # between two of the bounds ids are dealt evenly
    lows = F.array(*[F.lit(int(x)) for x in bounds])
    place = F.greatest(F.size(F.filter(lows, lambda x: x <= F.col("doc_id"))), F.lit(1))
    low, high = F.get(lows, place - 1), F.coalesce(F.get(lows, place), F.get(lows, place - 1) + 1)
    part = F.least(F.floor((F.col("doc_id") - low) * within / F.greatest(high - low, F.lit(1))), F.lit(within - 1))
    return docs.withColumn("bucket", (place * within + F.greatest(part, F.lit(0))).cast("long"))


def fingerprints(docs: DataFrame, low: float = 0.003, high: float = 0.05, task_bytes: int = 8 << 20) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they and its neighbour's are."""
    scratch = Scratch(docs.sparkSession)
    docs = keyed(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), "text")
    terms = scratch.table(lexicon(docs, low, high), "lexicon").union(docs.sparkSession.range(0, 1).select(F.lit(0).cast("long")))
    if terms.count() <= MOST_TERMS:
        terms = F.broadcast(terms)

    dealt = _bucketed(docs, task_bytes)
    order = Window.partitionBy("bucket").orderBy("doc_id", "text")
    rows = dealt.select("bucket", "doc_id", "text", F.lead("text").over(order).alias("after"), F.lead("doc_id").over(order).alias("after_id"), F.row_number().over(order).alias("place"))
    heads = dealt.select("bucket", "doc_id").groupBy("bucket").agg(F.min("doc_id").alias("head"))  # a short row a bucket
    heads = heads.select("bucket", F.coalesce(F.lead("head").over(Window.orderBy("bucket")), F.min("head").over(Window.partitionBy())).alias("head_id"))
    heads = scratch.table(heads, "heads")
    small = heads.select(F.col("head_id").alias("doc_id")).distinct()
    texts = docs.join(F.broadcast(small) if heads.count() <= MOST_TERMS else small, "doc_id").groupBy("doc_id").agg(F.min("text").alias("head_text"))
    heads = heads.join(texts.withColumnRenamed("doc_id", "head_id"), "head_id")
    rows = rows.join(heads, "bucket").select("bucket", "place", "doc_id", "text", F.coalesce("after", "head_text").alias("after"), F.coalesce("after_id", "head_id").alias("after_id"))

    n = F.char_length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - tail), F.substring("after", F.lit(1), tail))
    own, new = term_hashes(F.col("text")), F.transform(term_hashes(edited), lambda t: t.bitwiseOR(1))
    codes = F.concat(F.array(F.lit(0).cast("long")), own, new)  # a row for each term of either text; 0 is in every lexicon
    rows = rows.select("bucket", "place", "doc_id", "after_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("sha"), F.xxhash64("text").alias("own_all"), F.xxhash64(edited).alias("new_all"), codes.alias("codes"))
    # exploded in a step of its own: else what stands beside it would be worked out for each term
    rows = rows.select(*[c for c in rows.columns if c != "codes"], F.explode("codes").alias("code"))
    found = rows.withColumn("term", F.col("code").bitwiseAND(-2)).join(terms.toDF("term"), "term")
    of = lambda k: F.collect_list(F.when((F.col("code") != 0) & (F.col("code").bitwiseAND(1) == k), F.col("term")))
    same = ("doc_id", "after_id", "n_chars", "sha", "own_all", "new_all")
    gathered = found.groupBy("bucket", "place").agg(of(0).alias("own"), of(1).alias("new"), *(F.first(k).alias(k) for k in same))
    prints = gathered.select("doc_id", "after_id", "n_chars", "sha", fingerprint(F.col("own"), F.col("own_all")).alias("fingerprint"), fingerprint(F.col("new"), F.col("new_all")).alias("edited_fingerprint"))
    prints = scratch.table(prints, "prints")
    after = prints.groupBy(F.col("doc_id").alias("after_id")).agg(F.min("fingerprint").alias("after_print"))
    return prints.join(after, "after_id").select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("after_print")).alias("near_next"),
    )
