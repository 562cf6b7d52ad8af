"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. A cell's probability
is the product of a factor for each of its three values, 1 at most. Raking sets
the factors of one marginal after the other, each so that the expected tokens
of its value (probability times tokens) meet the target, until all three
marginals do. A hash of doc_id against its cell's probability decides, the same
in every run.

Targets are shares of the expected tokens, which are `share` of all tokens, for
each value, or an exponent: then a value's target is its share of tokens to
that power, normalised, so that below 1 large sources give way to small ones.
Values without a target keep their own share. No value can give more than FULL
of its tokens: a larger target is cut to that, and the rest goes to the other
values in proportion to theirs; report() names these. Where the three marginals
contradict each other, raking ends after ROUNDS, and report() shows by how much
they are missed.

A text's topic is one of eight groups of texts that share words beyond what is
usual in their language. Groups start from rare words: each votes for a part of
the vocabulary by log(texts / texts that have it), against the parts' votes at
large in that language. TURNS times, texts that have a word are counted by
group, and a text goes to the group for which the sum of its words' log-odds
over the language's own counts exceeds the language's mean by the most standard
deviations, so that texts without a subject spread over the groups. Words that
all groups use alike, as stop words, have log-odds near 0; those in fewer than
RARE texts have none.
Words, in lower case, are counted in BUCKETS by a hash of word and language, and
languages in SLOTS, so that these tables are of fixed size.

Null texts have no tokens, topic 0 and the probability of their cell; null
sources and languages are values of their own. Rows without doc_id are decided
by one and the same hash. Other columns don't matter; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesnp import U64, crc32_text, lowered, mix, prefix_hashes, span_hashes, text_runs, word_spans
from .common import Scratch

TOPICS = 8
BUCKETS, SLOTS, TURNS, RARE = 1 << 16, 64, 2, 5
PRIOR = 20.0  # texts with a word that are taken to be spread over the groups as the language's are
FEW = 1_000_000  # cells (some tens of bytes each) that are raked on the driver and broadcast; more are raked by Spark
KEYS = ("source", "lang", "topic")
FULL = 0.95  # of a value's tokens, that a target may ask for at most (share, if that is more)
ROUNDS, TOLERANCE = 200, 1e-9  # of raking, on the driver and by Spark: it stops when no marginal is further than that part of all expected tokens from its target
MOST_VALUES = 100_000  # rows of a marginal that may be broadcast
_NULL = "\0null"
Target = dict[str, float] | float
TARGETS: dict[str, Target] = {"source": 0.7, "lang": 0.7, "topic": 0.5}


def _worded(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, slot, words (different buckets, 16 bits each) and tokens of every row; nulls of source and lang spelled out."""

    def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            named = np.array([crc32_text(x) % SLOTS for x in langs.dictionary.to_pylist()], np.int32)
            slots = named[langs.indices.to_numpy(zero_copy_only=False)]
            for first, data, bounds in text_runs(batch.column("text"), 1 << 18):
                rows = len(bounds) - 1
                start, end, row = word_spans(data, bounds)
                slot = slots[first : first + rows]
                bucket = mix(span_hashes(prefix_hashes(lowered(data)), start, end) + slot[row].astype(U64)) % U64(BUCKETS)
                different = np.unique(row * BUCKETS + bucket.astype(np.int64))
                raw = (different % BUCKETS).astype(np.uint16).tobytes()
                edges = (2 * np.searchsorted(different, np.arange(rows + 1) * BUCKETS)).astype(np.int32)
                words = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(edges), pa.py_buffer(raw)])
                same = batch.slice(first, rows)
                tokens = pa.array(np.bincount(row, minlength=rows).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*(same.column(k) for k in ("doc_id", "source", "lang")), pa.array(slot), words, tokens], names=["doc_id", *KEYS[:2], "slot", "words", "tokens"])

    named = docs.select(F.col("doc_id").cast("long"), *(F.coalesce(F.col(k).cast("string"), F.lit(_NULL)).alias(k) for k in KEYS[:2]), "text")
    return named.mapInArrow(worded, "doc_id long, source string, lang string, slot int, words binary, tokens long")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(slot of each row, bucket and row of each word) of runs of a batch of _worded()."""
    slots = batch.column("slot").to_numpy()
    for first, data, bounds in text_runs(batch.column("words"), 1 << 18):
        rows = len(bounds) - 1
        yield slots[first : first + rows], data.view(np.uint16).astype(np.int64), np.repeat(np.arange(rows), np.diff(bounds) // 2)


@dataclass
class Groups:
    """How many texts of each group have each word, and are of each language."""

    words: np.ndarray  # BUCKETS x TOPICS
    texts: np.ndarray  # SLOTS x TOPICS
    mean: np.ndarray | None = None  # SLOTS x TOPICS: of the log-odds of words
    spread: np.ndarray | None = None  # their standard deviation
    votes: np.ndarray | None = None  # SLOTS x TOPICS: shares of the parts; then words vote for parts, and all texts are of one group

    def part_votes(self, slot: np.ndarray, bucket: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Thousandths of votes of each row for each part of the vocabulary."""
        n, every = self.words[:, 0], self.texts[:, 0]
        vote = np.rint(1000 * np.log(np.maximum(every[slot[row]] / np.maximum(n[bucket], 1), 1))) * (n[bucket] >= RARE)
        return np.bincount(row * TOPICS + bucket % TOPICS, vote, minlength=len(slot) * TOPICS).reshape(-1, TOPICS)

    def topics(self, slot: np.ndarray, bucket: np.ndarray, row: np.ndarray) -> np.ndarray:
        if self.votes is not None:
            found = self.part_votes(slot, bucket, row)
            return (found - found.sum(1)[:, None] * self.votes[slot]).argmax(1)
        known, odds = self.log_odds(slot, bucket, row)
        n = np.maximum(np.bincount(row[known], minlength=len(slot)), 1)
        sums = np.stack([np.bincount(row[known], x, minlength=len(slot)) for x in odds], 1)
        return ((sums - n[:, None] * self.mean[slot]) / (np.sqrt(n)[:, None] * self.spread[slot])).argmax(1)

    def log_odds(self, slot: np.ndarray, bucket: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which words are not rare, and for each group their log-odds."""
        share = np.maximum(self.texts, 1) / np.maximum(self.texts, 1).sum(1)[:, None]
        n = self.words.sum(1)
        known = np.flatnonzero(n[bucket] >= RARE)
        bucket, of = bucket[known], slot[row[known]]
        return known, [np.log((self.words[bucket, t] / share[of, t] + PRIOR) / (n[bucket] + PRIOR)) for t in range(TOPICS)]


def _tallied(worded: DataFrame, size: int, tally) -> np.ndarray:
    """Sums over all runs of tally(slot, bucket, row), an array of a fixed size."""

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for run in _runs(batch):
                sums += tally(*run)
        keys = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys.astype(np.int32)), "n": pa.array(sums[keys])})

    found = worded.select("slot", "words").mapInArrow(tallied, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[found["key"].to_numpy()] = found["n"].to_numpy()
    return out


def _counted(worded: DataFrame, groups: Groups | None) -> Groups:
    """The counts of the groups that texts go to; without groups, all go to the first."""
    shared = worded.sparkSession.sparkContext.broadcast(groups)

    def tally(slot: np.ndarray, bucket: np.ndarray, row: np.ndarray) -> np.ndarray:
        topic = shared.value.topics(slot, bucket, row) if shared.value else np.zeros(len(slot), np.int64)
        return np.r_[np.bincount(bucket * TOPICS + topic[row], minlength=BUCKETS * TOPICS), np.bincount(slot * TOPICS + topic, minlength=SLOTS * TOPICS)]

    sums = _tallied(worded, (BUCKETS + SLOTS) * TOPICS, tally).reshape(-1, TOPICS)
    shared.destroy()
    return Groups(sums[:BUCKETS], sums[BUCKETS:])


def _levelled(worded: DataFrame, groups: Groups) -> Groups:
    """The groups, with the mean and the spread of the log-odds of each language's words."""
    shared = worded.sparkSession.sparkContext.broadcast(groups)

    def tally(slot: np.ndarray, bucket: np.ndarray, row: np.ndarray) -> np.ndarray:
        known, odds = shared.value.log_odds(slot, bucket, row)
        of = slot[row[known]]
        sums = [np.bincount(of, minlength=SLOTS)]
        for x in odds:
            whole = np.rint(1000 * x)  # sums of whole numbers don't depend on their order
            sums += [np.bincount(of, whole, minlength=SLOTS), np.bincount(of, whole**2, minlength=SLOTS)]
        return np.concatenate(sums).astype(np.int64)

    sums = _tallied(worded, (1 + 2 * TOPICS) * SLOTS, tally).reshape(-1, SLOTS).T
    shared.destroy()
    n = np.maximum(sums[:, :1], 1)
    mean = sums[:, 1::2] / n / 1000
    spread = np.sqrt(np.maximum(sums[:, 2::2] / n / 1e6 - mean**2, 1e-6))
    return Groups(groups.words, groups.texts, mean, spread)


def learn(worded: DataFrame) -> Groups:
    """The groups after TURNS passes."""
    start = _counted(worded, None)
    shared = worded.sparkSession.sparkContext.broadcast(start)

    def tally(slot: np.ndarray, bucket: np.ndarray, row: np.ndarray) -> np.ndarray:
        votes = shared.value.part_votes(slot, bucket, row)
        return np.stack([np.bincount(slot, votes[:, t], minlength=SLOTS) for t in range(TOPICS)], 1).ravel().astype(np.int64)

    votes = _tallied(worded, SLOTS * TOPICS, tally).reshape(SLOTS, TOPICS)
    shared.destroy()
    groups = Groups(start.words, start.texts, votes=votes / np.maximum(votes.sum(1), 1)[:, None])
    for _ in range(TURNS):
        groups = _levelled(worded, _counted(worded, groups))
    return groups


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, tokens of every row; nulls of source and lang spelled out."""
    worded = Scratch(docs.sparkSession).table(_worded(docs), "worded")
    shared = docs.sparkSession.sparkContext.broadcast(learn(worded))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topics = [shared.value.topics(*run) for run in _runs(batch)]
            topic = pa.array([str(x) for run in topics for x in run], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "source", "lang")), topic, batch.column("tokens")], names=["doc_id", *KEYS, "tokens"])

    return worded.mapInArrow(measured, "doc_id long, source string, lang string, topic string, tokens long")


def poured(want: np.ndarray, room: np.ndarray, total: float) -> np.ndarray:
    """Parts of total in proportion to want, none above its room; all the room there is if that is less.

    The sum is concave and piecewise linear in the common scale, so Newton's
    method from below meets it when no further part is full.
    """
    scale = 0.0
    while True:
        full = scale * want >= room
        rest = want[~full].sum()
        met = (total - room[full].sum()) / rest if rest > 0 else scale
        if met <= scale * (1 + 1e-12):
            return np.minimum(scale * want, room)
        scale = met


def _targets(marginal: np.ndarray, values: list, target: Target, share: float) -> np.ndarray:
    """Expected tokens that each value shall have."""
    total = float(marginal.sum())
    part = marginal / max(total, 1.0)
    want = part**target if not isinstance(target, dict) else np.array([target.get(k, v) for k, v in zip(values, part.tolist(), strict=True)], float)
    want = np.where(marginal > 0, want, 0.0)
    return poured(want / max(want.sum(), 1e-300), marginal * max(FULL, share), share * total)


def _factors(code: np.ndarray, n: int, weight: np.ndarray, tokens: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each value the factor by which the cells' weights meet its target, with probabilities of 1 at most."""
    factor = np.zeros(n)
    for _ in range(len(weight) + 1):
        capped = weight * factor[code] >= 1
        full = np.bincount(code, np.where(capped, tokens, 0), n)
        rest = np.bincount(code, np.where(capped, 0, weight * tokens), n)
        met = np.divide(target - full, rest, out=factor.copy(), where=(rest > 0) & (target > full))
        if (met <= factor * (1 + 1e-12)).all():
            break
        factor = np.maximum(met, factor)
    return factor


def rake(cells: pd.DataFrame, targets: dict[str, Target], share: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """The probability of each cell (columns of KEYS and tokens)."""
    tokens = cells["tokens"].to_numpy(float)
    weight = np.full(len(cells), share)
    codes = {k: pd.factorize(cells[k])[0] for k in KEYS}
    wanted = {k: _targets(np.bincount(codes[k], tokens), list(pd.unique(cells[k])), targets.get(k, 1.0), share) for k in KEYS}
    for _ in range(rounds):
        off = 0.0
        for k in KEYS:
            now = np.bincount(codes[k], np.minimum(1, weight) * tokens, len(wanted[k]))
            off = max(off, np.abs(now - wanted[k]).max(initial=0) / max(tokens.sum() * share, 1e-300))
            factor = _factors(codes[k], len(wanted[k]), weight, tokens, wanted[k])
            weight = np.where(tokens > 0, weight * factor[codes[k]], weight)
        if off < tolerance:
            break
    return np.minimum(1, weight)


def _pour_wide(values: DataFrame, total: float) -> float:
    """The scale of poured() for a table of want and room."""
    scale = 0.0
    while True:
        full = F.col("want") * scale >= F.col("room")
        fixed, rest = values.agg(F.sum(F.when(full, F.col("room")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("want")))).first()
        met = (total - fixed) / rest if rest else scale
        if met <= scale * (1 + 1e-12):
            return scale
        scale = met


def rake_wide(cells: DataFrame, targets: dict[str, Target], share: float, scratch: Scratch, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The same for cells beyond FEW, in grouped sums; KEYS and probability."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    wanted = {}
    for k in KEYS:
        target = targets.get(k, 1.0)
        own = F.col("raw") / max(total, 1)
        want = F.coalesce(*(F.when(F.col(k) == v, F.lit(float(x))) for v, x in target.items()), own) if isinstance(target, dict) else F.pow(own, F.lit(float(target)))
        values = cells.groupBy(k).agg(F.sum("tokens").alias("raw")).select(k, F.when(F.col("raw") > 0, want).otherwise(0.0).alias("want"), (F.col("raw") * max(FULL, share)).alias("room"))
        values = scratch.table(values, f"wanted_{k}")  # a row a value
        count, norm = values.agg(F.count(F.lit(1)), F.sum("want")).first()
        values = values.withColumn("want", F.col("want") / (norm or 1.0))
        scale = _pour_wide(values, share * total) if total else 0.0
        wanted[k] = values.select(k, F.least(F.col("want") * scale, F.col("room")).alias("target")), count <= MOST_VALUES
    def settled(rows: DataFrame, few: bool, name: str) -> DataFrame:
        """rows without their lineage: at most MOST_VALUES of them through the driver, more as a written table."""
        return cells.sparkSession.createDataFrame(rows.collect(), rows.schema) if few else scratch.table(rows, name)

    now, last = scratch.table(cells.select(*KEYS, "tokens", F.lit(float(share)).alias("weight")), "rake_start"), "rake_start"
    for turn in range(rounds):
        off = 0.0
        for k, (values, few) in wanted.items():
            spread = (lambda x, few=few: F.broadcast(x) if few else x)
            sums = now.groupBy(k).agg(F.sum(F.least(F.lit(1.0), F.col("weight")) * F.col("tokens")).alias("have")).join(values, k)
            off = max(off, (sums.agg(F.max(F.abs(F.col("have") - F.col("target")))).first()[0] or 0.0) / max(total * share, 1e-300))
            factors, inner, moved = values.withColumn("factor", F.lit(0.0)), 0, True
            while moved:  # Newton's method from below, for all values at once
                capped = F.col("weight") * F.col("factor") >= 1
                own = now.join(spread(factors.select(k, "factor")), k)
                own = own.groupBy(k).agg(F.sum(F.when(capped, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight") * F.col("tokens"))).alias("rest"))
                met = F.when((F.col("rest") > 0) & (F.col("target") > F.col("full")), F.greatest((F.col("target") - F.col("full")) / F.col("rest"), "factor")).otherwise(F.col("factor"))
                inner += 1
                new = settled(factors.join(own, k).select(k, "target", met.alias("factor"), (met > F.col("factor") * (1 + 1e-12)).alias("moved")), few, f"factors_{turn}_{k}_{inner}")
                moved, factors = not new.where("moved").isEmpty(), new.drop("moved")
            now = now.join(spread(factors.select(k, "factor")), k).select(*KEYS, "tokens", F.when(F.col("tokens") > 0, F.col("weight") * F.col("factor")).otherwise(F.col("weight")).alias("weight"))
            now = scratch.table(now, f"rake_{turn}_{k}")
            scratch.drop(last)
            last = f"rake_{turn}_{k}"
        if off < tolerance:
            break
    return now.select(*KEYS, F.least(F.lit(1.0), F.col("weight")).alias("probability"))


def mix_sources(docs: DataFrame, targets: dict[str, Target] | None = None, share: float = 0.8, few: int = FEW) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight (probability over the mean one), probability and sampled of every document."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    targets = TARGETS if targets is None else targets
    rows = scratch.table(measure(docs), "measured")
    cells = scratch.table(rows.groupBy(*KEYS).agg(F.sum("tokens").alias("tokens")), "cells")
    if cells.count() <= few:
        own = cells.toPandas().sort_values(list(KEYS), ignore_index=True)
        own["probability"] = rake(own, targets, share)
        schema = "source string, lang string, topic string, probability double"
        fitted = F.broadcast(spark.createDataFrame(own[[*KEYS, "probability"]], schema) if len(own) else spark.createDataFrame([], schema))
    else:
        fitted = rake_wide(cells, targets, share, scratch)
    chance = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 53)) / float(1 << 53)
    shown = [F.when(F.col(k) != _NULL, F.col(k)).alias(k) for k in KEYS[:2]]
    return rows.join(fitted, list(KEYS)).select("doc_id", *shown, "topic", "tokens", (F.col("probability") / share).alias("weight"), "probability", (chance < F.col("probability")).alias("sampled"))


def report(mixed: DataFrame, targets: dict[str, Target] | None = None, share: float = 0.8) -> DataFrame:
    """Of each value of each marginal of mix_sources() its tokens, and its target, expected and drawn shares of the sample.

    The plain target is what was asked for; `target` is that after the cut to
    FULL, and `cut` says where it was cut. One row a value.
    """
    spark = mixed.sparkSession
    targets = TARGETS if targets is None else targets
    drawn = F.sum(F.when(F.col("sampled"), F.col("tokens")).otherwise(0))
    out = []
    for k in KEYS:
        own = mixed.groupBy(F.coalesce(F.col(k), F.lit(_NULL)).alias("value")).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("probability") * F.col("tokens")).alias("expected"), drawn.alias("drawn")).toPandas()
        tokens = own["tokens"].to_numpy(float)
        target = _targets(tokens, own["value"].tolist(), targets.get(k, 1.0), share)
        plain = targets.get(k, 1.0)
        part = tokens / max(tokens.sum(), 1.0)
        asked = np.where(tokens > 0, part**plain if not isinstance(plain, dict) else [plain.get(v, x) for v, x in zip(own["value"], part, strict=True)], 0.0)
        asked = asked / max(asked.sum(), 1e-300)
        for i, row in enumerate(own.itertuples()):
            shares = [x / max(y, 1e-300) for x, y in ((target[i], target.sum()), (row.expected, own["expected"].sum()), (row.drawn, own["drawn"].sum()))]
            out.append((k, None if row.value == _NULL else row.value, int(row.tokens), float(asked[i]), *map(float, shares), bool(target[i] >= tokens[i] * max(FULL, share) * (1 - 1e-9) and tokens[i] > 0)))
    return spark.createDataFrame(out, "marginal string, value string, tokens long, asked double, target double, expected double, drawn double, cut boolean")


def keep_sampled(docs: DataFrame, targets: dict[str, Target] | None = None, share: float = 0.8) -> DataFrame:
    """The rows of docs that are sampled, columns as they are; of rows that share a doc_id, all if one is."""
    chosen = mix_sources(docs, targets, share).where("sampled").select(F.col("doc_id").alias("chosen_id")).distinct()
    plain, columns = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), docs.columns
    own = F.col(f"c{columns.index('doc_id')}").cast("long")
    return plain.join(chosen, own.eqNullSafe(F.col("chosen_id")), "left_semi").toDF(*columns)
