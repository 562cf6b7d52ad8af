"""Quality rules: word counts, repeats, and n-gram perplexity in bands by language.

The language model is a modified Kneser-Ney model over words, hashed to 40 bits.
Copies of documents must not make each other's words likely, so evidence is
counted in different contexts at both orders, as Kneser-Ney does at its lower
ones: a word by the different words that stand ahead of it anywhere, a pair of
words by the different words ahead of the pair. Pairs are kept where both words
are FREQUENT (a share of 1 / 1000 or more of all different pairs, so 1000 words
at most, whatever the corpus); the rest of a context's mass goes to the words by
their own share. Words are kept without bound: the table of their hashes and
counts, sorted arrays in as many slices as the corpus asks for, grows with it.
Words met in one context only need no entry, since all words of the corpus were
counted: what the arrays lack has count 1.

Spark counts over all texts. Tasks gather different pairs of some MB of text at
a time and deal them by word to the slices, which merge them. Scoring reads the
table as a broadcast while it has at most FEW entries; a larger one is joined to
the texts' distinct words by a shuffle, with the same results.

A document's score is the mean negative log2 probability of its words. Bands
are set for each language from the scores of all its documents that pass the
base rules: further from the median than `reach` times the distance between the
quartiles is out, and for short texts, whose mean strays more, that distance is
multiplied by sqrt(1 + short_words / words).

Null texts have no words and fail. Null languages form a language of their
own. Rows keep their doc_id, null or repeated; no rows give no rows. Long texts
are hashed in blocks; their words' hashes are held at once. Other columns are
not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesnp import LEAD, SPACE, U64, hashes_of, mix, per_row, text_runs, word_spans
from .common import Scratch, pieces_for

FREQUENT: int | None = None  # if set, only pairs of words that each have this part of all pairs are kept
FEW = 4_000_000  # entries of the word table (13 bytes each) that are broadcast
GATHERED = 8 << 20  # bytes of text whose pairs are gathered before they are sent
MOST_LANGUAGES = 100_000  # rows of bands that may be broadcast
BITS, AHEAD = 40, 24  # of a word's hash, and of the hash of the word ahead of it
_START = U64(0x5851F42D4C957F2D)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word, and its full hash."""
    start, end, row = word_spans(data, bounds)
    return start, end, row, hashes_of(data, start, end)


def before(words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The word ahead of each within its row, or the mark of a beginning."""
    out = np.full(len(words), _START, U64)
    if len(words):
        out[1:] = np.where(row[1:] == row[:-1], words[:-1], _START)
    return out


def _short(words: np.ndarray) -> np.ndarray:
    return words >> U64(64 - BITS)


def _distinct_pairs(keys: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, U64)


PAIRS = "slice int, body binary"


def _send_pairs(slices: int):
    """Messages: for each slice of the words, words of 5 bytes, how many contexts each has, and these, 3 bytes each."""

    def messages(pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        words, first, count = np.unique(pairs >> U64(AHEAD), return_index=True, return_counts=True)
        edges = np.searchsorted(words, np.array([(i << BITS) // slices for i in range(slices + 1)], U64))
        for i in np.flatnonzero(np.diff(edges)).tolist():
            a, b = int(edges[i]), int(edges[i + 1])
            own = pairs[first[a] : first[b - 1] + count[b - 1]]
            body = struct.pack("<I", b - a) + _packed(words[a:b], 5) + count[a:b].astype("<u4").tobytes() + _packed(own & U64((1 << AHEAD) - 1), 3)
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "body": pa.array([body], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, size = [], 0
        for batch in batches:
            for _, data, bounds in text_runs(batch.column("text")):
                _, _, row, words = word_hashes(data, bounds)
                keys.append(np.unique((_short(words) << U64(AHEAD)) | (mix(before(words, row)) >> U64(64 - AHEAD))))
                size += len(data)
                if size >= GATHERED:
                    yield from messages(_distinct_pairs(keys))
                    keys, size = [], 0
        if keys:
            yield from messages(_distinct_pairs(keys))

    return run


def _packed(values: np.ndarray, size: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _unpacked(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


SLICE = "slice int, n_words long, n_pairs long, n1 long, n2 long, n3 long, n4 long, hashes binary, counts binary"


def _merge_pairs(table: pa.Table) -> pa.Table:
    """A slice of the word table: sorted hashes of the words with two contexts or more, and how many these are."""
    keys = []
    for body in table.column("body"):
        raw = body.as_py()
        n = struct.unpack_from("<I", raw)[0]
        words, count = _unpacked(raw[4 : 4 + 5 * n], 5), np.frombuffer(raw, "<u4", n, 4 + 5 * n)
        keys.append((np.repeat(words, count) << U64(AHEAD)) | _unpacked(raw[4 + 9 * n :], 3))
    words, seen = np.unique(_distinct_pairs(keys) >> U64(AHEAD), return_counts=True)
    space = float(1 << AHEAD)  # contexts whose hashes fall together are made up for
    count = np.rint(-space * np.log1p(-np.minimum(seen, space - 1) / space)).astype(np.int64)
    some = count > 1
    row = {"slice": table.column("slice")[0].as_py(), "n_words": len(words), "n_pairs": int(count.sum()), **{f"n{i}": int((count == i).sum()) for i in (1, 2, 3, 4)}, "hashes": words[some].astype("<u8").tobytes(), "counts": count[some].astype("<u4").tobytes()}
    kinds = [("slice", pa.int32()), *((k, pa.int64()) for k in ("n_words", "n_pairs", "n1", "n2", "n3", "n4")), ("hashes", pa.binary()), ("counts", pa.binary())]
    return pa.Table.from_pylist([row], pa.schema(kinds))


def word_table(docs: DataFrame, scratch: Scratch, slice_bytes: int = 16 << 20) -> DataFrame:
    """The word table in slices by hash; a row a slice."""
    slices = pieces_for(docs, slice_bytes)
    sent = docs.select("text").mapInArrow(_send_pairs(slices), PAIRS).repartition(slices, "slice")
    return scratch.table(sent.groupBy("slice").applyInArrow(_merge_pairs, SLICE), "words")


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Of counts 0, 1, 2 and more, from counts of counts."""
    n1, n2, n3, n4 = (max(int(x), 1) for x in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(min(max(d, 0.1), 0.9 * i) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))])


@dataclass
class Model:
    """Discounts and totals of the words, and the frequent words with what follows them."""

    cut: np.ndarray
    n_words: int
    n_pairs: int
    n_cut: float  # what the discounts took from all words
    frequent: np.ndarray  # sorted hashes
    own: np.ndarray  # their counts
    pairs: np.ndarray | None = None  # log2 probability of a frequent word (column) after another (row)
    rest: np.ndarray | None = None  # log2 share of a frequent context that goes to the words by themselves

    def word_log2(self, count: np.ndarray) -> np.ndarray:
        """log2 probability of words by their counts."""
        count = np.asarray(count, float)
        taken = self.cut[np.minimum(count, 3).astype(int)]
        return np.log2(np.maximum(count - taken, 0) / max(self.n_pairs, 1) + self.n_cut / max(self.n_pairs, 1) / max(self.n_words, 1))

    def ids(self, words: np.ndarray) -> np.ndarray:
        """Places of words among the frequent ones, -1 for others."""
        return found(self.frequent, words)

    def known(self, word: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log2 of what is known without the word table, and where the word's own log2 is still to be added."""
        w, h = self.ids(word), self.ids(ahead)
        out = np.where(h >= 0, self.rest[h] if len(self.rest) else 0.0, 0.0)
        some = (h >= 0) & (w >= 0)
        if some.any():
            out[some] = self.pairs[h[some], w[some]]
        only = (h < 0) & (w >= 0)
        if only.any():
            out[only] = self.word_log2(self.own[w[only]])
        return out, w < 0


def found(table: np.ndarray, words: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(table, words), len(table) - 1)
    return np.where(table[at] == words, at, -1)


def unigram_model(words: DataFrame) -> Model:
    """Totals of all slices, and the frequent words: a row a slice of six numbers, and FREQUENT words at most."""
    total = words.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("n_words", "n_pairs", "n1", "n2", "n3", "n4"))).first()
    cut = discounts(total.n1, total.n2, total.n3, total.n4)
    n_cut = cut[1] * total.n1 + cut[2] * total.n2 + cut[3] * (total.n_words - total.n1 - total.n2)
    least = max(2, -(-total.n_pairs // FREQUENT))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, counts in zip(batch.column("hashes"), batch.column("counts"), strict=True):
                h, n = np.frombuffer(hashes.as_py(), "<u8"), np.frombuffer(counts.as_py(), "<u4")
                yield pa.RecordBatch.from_pydict({"h": pa.array(h[n >= least].view(np.int64)), "n": pa.array(n[n >= least].astype(np.int64))})

    top = words.select("hashes", "counts").mapInArrow(chosen, "h long, n long").toPandas().sort_values("h")
    return Model(cut, total.n_words, total.n_pairs, float(n_cut), top["h"].to_numpy(np.int64).astype(U64), top["n"].to_numpy(float))


def count_pairs(docs: DataFrame, model: Model) -> DataFrame:
    """(pair, contexts, times) of frequent words after frequent words; pair: both places in one number, column -1 for all other words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n = len(model.frequent)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = np.zeros(0, U64), np.zeros(n * (n + 1), np.int64)
        held = [np.zeros(0, U64)]
        for batch in batches:
            for _, data, bounds in text_runs(batch.column("text")):
                _, _, row, full = word_hashes(data, bounds)
                words, ahead = _short(full), before(full, row)
                w, h = shared.value.ids(words), shared.value.ids(_short(ahead))
                pair = h * (n + 1) + np.where(w >= 0, w, n)
                times += np.bincount(pair[h >= 0], minlength=len(times))
                both = (h >= 0) & (w >= 0)
                further = np.r_[_START, ahead[:-1]][: len(ahead)]
                further = np.where(ahead == _START, _START, further)
                held.append(np.unique((pair[both].astype(U64) << U64(40)) | (mix(further[both]) >> U64(24))))
                if sum(map(len, held)) > 1 << 20:
                    held = [np.unique(np.concatenate(held))]
                    if len(held[0]) > 1 << 20:
                        yield pa.RecordBatch.from_pydict({"key": pa.array(held[0].view(np.int64)), "times": pa.array(np.zeros(len(held[0]), np.int64))})
                        held = [np.zeros(0, U64)]
        keys = np.unique(np.concatenate(held))
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "times": pa.array(np.zeros(len(keys), np.int64))})
        some = np.flatnonzero(times)
        yield pa.RecordBatch.from_pydict({"key": pa.array(-1 - some), "times": pa.array(times[some])})

    rows = docs.select("text").mapInArrow(counted, "key long, times long").groupBy("key").agg(F.sum("times").alias("times"))
    pair = F.when(F.col("key") < 0, -1 - F.col("key")).otherwise(F.call_function("shiftright", F.col("key"), F.lit(40)))
    return rows.groupBy(pair.alias("pair")).agg(F.sum((F.col("key") >= 0).cast("long")).alias("contexts"), F.sum("times").alias("times"))


def with_pairs(model: Model, counted: DataFrame) -> Model:
    """The model with its pairs: (FREQUENT + 1) squared rows at most."""
    n = len(model.frequent)
    rows = counted.toArrow()
    contexts, times = np.zeros(n * (n + 1)), np.zeros(n * (n + 1))
    contexts[rows["pair"].to_numpy()], times[rows["pair"].to_numpy()] = rows["contexts"].to_numpy(), rows["times"].to_numpy()
    contexts, times = contexts.reshape(n, n + 1)[:, :n], times.reshape(n, n + 1)
    cut = discounts(*((contexts == i).sum() for i in (1, 2, 3, 4)))
    kept = np.where(contexts > 0, contexts - cut[np.minimum(contexts, 3).astype(int)], 0.0)
    inside = times[:, :n].sum(1)
    total = np.maximum(contexts.sum(1), 1) * np.maximum(times.sum(1), 1) / np.maximum(inside, 1)  # as if all followers had been counted so
    rest = np.clip(1 - kept.sum(1) / total, 1e-9, 1)
    own = 2 ** model.word_log2(model.own)
    pairs = np.log2(kept / total[:, None] + rest[:, None] * own[None, :]) if n else np.zeros((0, 0))
    return Model(model.cut, model.n_words, model.n_pairs, model.n_cut, model.frequent, model.own, pairs, np.log2(rest))


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: is it there twice or more, and did it come before."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:]] = same
    later[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def base_counts(data: np.ndarray, bounds: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each row: words, their characters, symbols, repeated lines, words in repeated windows.

    start, end, row, words: where the words are, of which row, and their hashes.
    """
    rows = len(bounds) - 1
    out = {"n_words": np.bincount(row, minlength=rows)}
    solid = ~SPACE[data]
    out["word_chars"] = per_row(LEAD[data] & solid, bounds)
    out["n_symbols"] = per_row(_SYMBOL[data], bounds)
    feeds = np.flatnonzero(data == 10)
    line_row = np.r_[np.arange(rows), np.searchsorted(bounds, feeds, "right") - 1]
    line_start = np.r_[bounds[:-1], feeds + 1]
    order = np.lexsort((line_start, line_row))
    line_row, line_start = line_row[order], line_start[order]
    last = np.r_[line_row[1:] != line_row[:-1], True]
    line_end = np.where(last, bounds[line_row + 1], np.r_[line_start[1:] - 1, 0])
    some = np.searchsorted(start, line_end) > np.searchsorted(end, line_start, "right")  # lines with a word
    keys = mix(hashes_of(data, line_start[some], line_end[some]) + mix(line_row[some].astype(U64)))
    out["n_dup_lines"] = np.bincount(line_row[some][_repeats(keys)[1]], minlength=rows)
    covered = np.zeros(len(start) + 1, np.int64)
    if len(start) >= 5:
        h = words
        window = mix(row[:-4].astype(U64))
        for i in range(5):
            window = mix(window * U64(0x9E3779B97F4A7C15) + h[i : len(h) - 4 + i])
        at = np.flatnonzero(row[4:] == row[:-4])
        at = at[_repeats(window[at])[0]]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + 5, -1)
    out["n_repeat_words"] = np.bincount(row[np.cumsum(covered)[:-1] > 0], minlength=rows)
    return {k: v.astype(np.int64) for k, v in out.items()}


SCORED = "row long, doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log2 double"


def score_documents(docs: DataFrame, model: Model, table: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """row (a number of its own), doc_id, lang, base counts and log2 (of all words' probability) of every document.

    table: sorted hashes and counts of all words; without it log2 lacks what the
    words that are not frequent give by themselves, and `words` and `times` list these.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, table))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model, own_table = shared.value
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, data, bounds in text_runs(batch.column("text")):
                rows = len(bounds) - 1
                start, end, row, full = word_hashes(data, bounds)
                out = base_counts(data, bounds, start, end, row, full)
                words = _short(full)
                value, open_ = own_model.known(words, _short(before(full, row)))
                if own_table is not None:
                    at = found(own_table[0], words[open_])
                    value[open_] += own_model.word_log2(np.where(at >= 0, own_table[1][at], 1) if len(own_table[0]) else np.ones(len(at)))
                log2 = np.bincount(row, value, rows)
                same = batch.slice(first, rows)
                columns = [pa.array(number + np.arange(rows)), same.column("doc_id"), same.column("lang"), *(pa.array(x) for x in out.values()), pa.array(log2)]
                names = ["row", "doc_id", "lang", *out, "log2"]
                number += rows
                if own_table is None:
                    each, times = np.unique(np.stack([row[open_].astype(U64), words[open_]], 1), axis=0, return_counts=True)
                    edges = pa.array(np.searchsorted(each[:, 0], np.arange(rows + 1)).astype(np.int32))
                    columns += [pa.ListArray.from_arrays(edges, pa.array(each[:, 1].astype(np.int64))), pa.ListArray.from_arrays(edges, pa.array(times.astype(np.int64)))]
                    names += ["words", "times"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    columns = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")
    return columns.mapInArrow(scored, SCORED if table is not None else f"{SCORED}, words array<long>, times array<long>")


def _whole_table(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The slices' arrays as one, for at most FEW entries."""
    rows = words.select("slice", "hashes", "counts").toArrow().sort_by("slice")
    joined = [b"".join(rows[k].to_pylist()) for k in ("hashes", "counts")]
    return np.frombuffer(joined[0], "<u8"), np.frombuffer(joined[1], "<u4")


def _joined(scores: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    """Scores completed by a shuffled join of the documents' words with the word table."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hashes, counts in zip(batch.column("hashes"), batch.column("counts"), strict=True):
                h, n = np.frombuffer(hashes.as_py(), "<u8"), np.frombuffer(counts.as_py(), "<u4")
                yield pa.RecordBatch.from_pydict({"word": pa.array(h.view(np.int64)), "own": pa.array(model.word_log2(n))})

    table = words.select("hashes", "counts").mapInArrow(entries, "word long, own double")
    each = scores.select("row", F.inline(F.arrays_zip("words", "times"))).toDF("row", "word", "times").join(table, "word", "left")
    sums = each.groupBy("row").agg(F.sum(F.col("times") * F.coalesce("own", F.lit(float(model.word_log2(np.ones(1))[0])))).alias("more"))
    return scores.drop("words", "times").join(sums, "row", "left").withColumn("log2", F.col("log2") + F.coalesce("more", F.lit(0.0))).drop("more")


def pruned_scores(docs: DataFrame, scratch: Scratch, few: int) -> DataFrame:
    """Scores by the pairs of frequent words only."""
    words = word_table(docs, scratch)
    model = unigram_model(words)
    model = with_pairs(model, count_pairs(docs, model))
    entries = words.agg(F.coalesce(F.sum(F.octet_length("counts") / 4), F.lit(0))).first()[0]
    if entries <= few:
        return scratch.table(score_documents(docs, model, _whole_table(words)), "scores")
    return scratch.table(_joined(scratch.table(score_documents(docs, model, None), "open_scores"), words, model), "scores")


def quality_rules(docs: DataFrame, reach: float = 2.2, short_words: int = 150, few: int = FEW) -> DataFrame:
    """Base counts, base_failed, kept, perplexity and its language's band, of every document."""
    from . import word_pairs  # it takes the words from here

    scratch = Scratch(docs.sparkSession)
    whole = FREQUENT is None
    scores = scratch.table(word_pairs.score_documents(docs), "scores") if whole else pruned_scores(docs, scratch, few)
    scores = scores.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    orders = {"": "log2", "word_": "words_log2"} if whole else {"": "log2"}
    for name, log2 in orders.items():
        scores = scores.withColumn(f"{name}bits", -F.col(log2) / F.greatest("n_words", F.lit(1)))
    quartiles = (F.percentile_approx(f"{name}bits", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 100_000).alias(f"{name}q") for name in orders)
    bands = scratch.table(scores.where(~F.col("base_failed")).groupBy("lang").agg(*quartiles), "bands")
    if bands.count() <= MOST_LANGUAGES:
        bands = F.broadcast(bands)

    def edge(name: str, side: int) -> Column:
        q = F.col(f"{name}q")
        return q[1] + side * (q[2] - q[0]) * reach * F.sqrt(1 + short_words / F.greatest("n_words", F.lit(1)))

    least = "word_" if whole else ""
    good = F.col(f"{least}bits") >= edge(least, -1)
    for name in orders:
        good &= F.col(f"{name}bits") <= edge(name, 1)
    out = [F.pow(F.lit(2.0), x).alias(f"{name}{kind}") for name in orders for kind, x in (("perplexity", F.col(f"{name}bits")), ("low", edge(name, -1)), ("high", edge(name, 1)))]
    return scores.join(bands, "lang", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(good, F.lit(False))).alias("kept"), *out)
