"""Perplexity of texts by all pairs of words: Kneser-Ney of order 2 without pruning, by exchange of sorted hashes.

Evidence for a pair of words is the number of different words ahead of it, and
for a word the number of different words ahead of it, so copies count once. A
pair met behind one word only is what its own text says of itself: it counts for
its first word's total, and all of its evidence goes to the second word by
itself (a discount of 1). First words of texts are scored by themselves.

Nothing is kept for the commonest words only, and nothing is broadcast but ten
sums. Texts are gathered to chunks. Each chunk deals its different (word, word,
word) by pair to slices and each slice answers with the evidence of the chunk's
pairs; one chunk of those that hold a pair adds it to the sums of its two words;
these are dealt by word, merged and answered in the same way. Chunks meet their
answers by zip, so texts are never shuffled. All messages are sorted hashes
without their common parts: pairs of 44 bits, contexts of 20, words of 40;
contexts whose hashes fall together are made up for.
"""

from __future__ import annotations

import contextlib
import ctypes
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesnp import U64, mix, text_runs
from .perplexity import _START, _short, base_counts, before, discounts, word_hashes

PAIR, BEHIND, WORD = 44, 20, 40  # bits of hashes of pairs, of the words ahead of them, and of words
CHUNK = 32 << 20  # bytes of text whose words are held at a time
SCORES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log2 double, words_log2 double"
SUMS = 5  # of a word: words ahead of it; evidence of the pairs it begins; how many of these have 1, 2, and 3 or more


def _zip(*arrays: tuple[np.ndarray, int]) -> bytes:
    """Arrays of whole numbers of so many bytes, plane by plane, compressed."""
    planes = [np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes() for a, size in arrays]
    raw = b"".join([struct.pack(f"<{len(arrays)}q", *(len(a) for a, _ in arrays)), *planes])
    return struct.pack("<q", len(raw)) + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unzip(body: bytes, *sizes: int) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(body[8:], struct.unpack_from("<q", body)[0], asbytes=True)
    out, at = [], 8 * len(sizes)
    for n, size in zip(struct.unpack_from(f"<{len(sizes)}q", raw), sizes, strict=True):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
        out.append(wide.view("<u8").ravel())
        at += n * size
    return out


def _sorted_out(values: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Sorted values: how many share each of their upper parts, and their lower 24 bits."""
    upper = (values >> U64(24)).astype(np.int64)
    base = int(upper[0]) if len(upper) else 0
    return [(np.array([base], U64), 8), (np.bincount(upper - base), 4), (values & U64((1 << 24) - 1), 3)]


def _sorted_in(base: np.ndarray, counts: np.ndarray, low: np.ndarray) -> np.ndarray:
    return ((np.repeat(np.arange(len(counts), dtype=U64), counts.astype(np.int64)) + base[0]) << U64(24)) | low


def _edges(values: np.ndarray, bits: int, slices: int) -> list[int]:
    return np.searchsorted(values, np.array([(i << bits) // slices for i in range(1, slices)], U64)).tolist()


def _dealt(values: np.ndarray, bits: int, slices: int) -> Iterator[tuple[int, int, int]]:
    """(slice, from, to) of the slices that have any of the sorted values, the first always."""
    cuts = [0, *_edges(values, bits, slices), len(values)]
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if not i or a < b:
            yield i, a, b


def packed(rows: Iterable) -> Iterator[tuple[bytes]]:
    """Chunks of rows (doc_id, lang, text), each as one compressed message."""

    def one(ids: list, langs: list, texts: list) -> tuple[bytes]:
        batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(texts, pa.large_binary()).cast(pa.large_string())], ["doc_id", "lang", "text"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        return (sink.getvalue().to_pybytes(),)

    held, size = ([], [], []), 0
    for doc_id, lang, text in rows:
        for own, x in zip(held, (doc_id, lang, (text or "").encode()), strict=True):
            own.append(x)
        size += len(held[2][-1])
        if size >= CHUNK:
            yield one(*held)
            held, size = ([], [], []), 0
            let_go()
    if held[0]:
        yield one(*held)
        del held
        let_go()


def runs(body: bytes) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of a chunk with the bytes of their texts, and the bounds in these."""
    for batch in pa.ipc.open_stream(body):
        for first, data, bounds in text_runs(batch.column("text")):
            yield batch.slice(first, len(bounds) - 1), data, bounds


NONE = ~U64(0)  # no word ahead


def of_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each word of a run: start, end, row, full hash, hash, the hash of the word ahead or NONE, and the hash of both."""
    start, end, row, full = word_hashes(data, bounds)
    ahead = before(full, row)
    return start, end, row, full, _short(full), np.where(ahead == _START, NONE, _short(ahead)), mix(mix(ahead) + full) >> U64(64 - PAIR)


def different(held: list[np.ndarray]) -> np.ndarray:
    """Sorted values of all the arrays, each once; the list is emptied."""
    out = np.concatenate([np.zeros(0, U64), *held])
    held.clear()
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]] if len(out) else out


class Chunk:
    """The different words and pairs of a chunk, sorted, and run by run where its words and pairs stand among them."""

    def __init__(self, body: bytes, counted: bool = False):
        self.rows, self.runs = [], []
        for same, data, bounds in runs(body):
            start, end, row, full, word, ahead, pair = of_words(data, bounds)
            if counted:
                self.rows.append((same.column("doc_id"), same.column("lang"), base_counts(data, bounds, start, end, row, full)))
            (own, word), (pairs, pair) = (np.unique(x, return_inverse=True) for x in (word, pair))
            self.runs.append((own, word.astype(np.int32), pairs, pair.astype(np.int32), row.astype(np.int32), ahead != NONE))
        self.words, self.pairs = different([x[0] for x in self.runs]), different([x[2] for x in self.runs])

    def places(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each run: rows, words, words ahead (-1: none) and pairs; its arrays go."""
        while self.runs:
            own, word, pairs, pair, row, inner = self.runs.pop(0)
            at = np.searchsorted(self.words, own)[word]
            yield row, at, np.where(inner, np.r_[-1, at[:-1]][: len(at)], -1), np.searchsorted(self.pairs, pairs)[pair]


def let_go() -> None:
    """Gives the memory of a chunk back, since workers live on beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def send_pairs(slices: int):
    """(slice, (part, chunk, message)): the chunk's different pairs, and the words ahead of each."""

    def run(part: int, rows: Iterable) -> Iterator[tuple]:
        for number, (body,) in enumerate(rows):
            held = []
            for _, data, bounds in runs(body):
                _, _, row, full, _, _, pair = of_words(data, bounds)
                ahead = before(full, row)
                further = np.r_[_START, ahead[:-1]][: len(ahead)]
                further = np.where(ahead == _START, _START, further)
                held.append(np.unique((pair << U64(BEHIND)) | (mix(further) >> U64(64 - BEHIND))))
            keys = different(held)
            for i, a, b in _dealt(keys, PAIR + BEHIND, slices):
                pairs, times = np.unique(keys[a:b] >> U64(BEHIND), return_counts=True)
                behind = np.r_[keys[a:b] & U64((1 << BEHIND) - 1), np.zeros((b - a) % 2, U64)]
                yield i, (part, number, _zip(*_sorted_out(pairs), (times, 4), (behind[::2] | (behind[1::2] << U64(BEHIND)), 5)))
            del keys
            let_go()

    return run


def merge_pairs(messages: Iterable) -> Iterator[tuple]:
    """(part, (chunk, 0, slice, answer)): evidence of the chunk's pairs in their order, doubled, and one more where this chunk is to sum them."""
    held: dict[int, list] = {}
    for i, message in messages:
        held.setdefault(i, []).append(message)
    for i in list(held):
        own = held.pop(i)
        asked, keys = [], []
        for part, number, body in sorted(own):
            *packed_pairs, times, two = _unzip(body, 8, 4, 3, 4, 5)
            pairs = _sorted_in(*packed_pairs)
            behind = np.stack([two & U64((1 << BEHIND) - 1), two >> U64(BEHIND)], 1).ravel()[: int(times.sum())]
            keys.append((np.repeat(pairs, times.astype(np.int64)) << U64(BEHIND)) | behind)
            asked.append((part, number, pairs))
        pairs, seen = np.unique(different(keys) >> U64(BEHIND), return_counts=True)
        space = float(1 << BEHIND)
        count = np.rint(-space * np.log1p(-np.minimum(seen, space - 1) / space)).astype(np.int64)
        taken = np.zeros(len(pairs), bool)
        for part, number, some in asked:
            at = np.searchsorted(pairs, some)
            yield part, (number, 0, i, _zip((2 * count[at] + ~taken[at], 5)))
            taken[at] = True
        del asked, own, pairs, seen, count, taken
        let_go()


def answers(rows: Iterable) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """The messages to each chunk of a part on its pairs and on its words, in order of chunks and slices."""
    held: dict[int, list] = {}
    for _, (number, *message) in rows:
        held.setdefault(number, []).append(message)
    for number in sorted(held):
        own = sorted(held.pop(number))
        yield tuple([body for kind, _, body in own if kind == k] for k in (0, 1))


def evidence(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    value = np.concatenate([_unzip(b, 5)[0] for b in bodies]).astype(np.int64)
    return value >> 1, (value & 1).astype(bool)


def _count_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5]


def send_words(slices: int):
    """(slice, (part, chunk, message)): the chunk's words with what its pairs add to their sums; to the first slice, how many pairs have 1 to 4, too."""

    def run(part: int, rows: Iterable) -> Iterator[tuple]:
        for number, ((body,), (bodies, _)) in enumerate(rows):
            chunk = Chunk(body)
            words, pairs = chunk.words, chunk.pairs
            count, own = evidence(bodies)
            if len(count) != len(pairs):
                raise RuntimeError("the documents changed between two readings")
            lead, after = np.zeros(len(pairs), np.int32), np.zeros(len(pairs), np.int32)
            for _, word, ahead, at in chunk.places():
                after[at], lead[at] = word, ahead
            some = own & (lead >= 0)
            after, lead, led = after[own], lead[some], count[some]
            sums = [np.bincount(after, minlength=len(words)), np.bincount(lead, led, len(words)).astype(np.int64), *(np.bincount(lead[m], minlength=len(words)) for m in (led == 1, led == 2, led > 2))]
            for i, a, b in _dealt(words, WORD, slices):
                yield i, (part, number, _zip(*_sorted_out(words[a:b]), *((s[a:b], 5) for s in sums), (np.zeros(0) if i else _count_of_counts(led), 5)))
            del chunk, words, pairs, count, own, lead, led, after, some, sums
            let_go()

    return run


def merge_words(messages: Iterable) -> Iterator[tuple]:
    """(part, (chunk, 1, slice, answer)): the sums of the chunk's words; and (-1, sums over all words of the slice)."""
    held: dict[int, list] = {}
    for i, message in messages:
        held.setdefault(i, []).append(message)
    for i in list(held):
        own = held.pop(i)
        asked, of_pairs = [], np.zeros(4, np.int64)
        for part, number, body in sorted(own):
            *packed_words, a, b, c, d, e, more = _unzip(body, 8, 4, 3, *[5] * (SUMS + 1))
            asked.append((part, number, _sorted_in(*packed_words), np.stack([a, b, c, d, e]).astype(np.int64)))
            of_pairs[: len(more)] += more.astype(np.int64)
        words, place = np.unique(np.concatenate([x[2] for x in asked]), return_inverse=True)
        sums = np.stack([np.bincount(place, s, len(words)) for s in np.concatenate([x[3] for x in asked], 1)]).astype(np.int64)
        yield -1, (len(words), int(sums[0].sum()), *_count_of_counts(sums[0]).tolist(), *of_pairs.tolist())
        for part, number, some, _ in asked:
            yield part, (number, 1, i, _zip(*((s, 5) for s in sums[:, np.searchsorted(words, some)])))


def score(totals: list[int]):
    """Rows of SCORES from chunks and both of their answers."""
    n_words, n_pairs = max(totals[0], 1), max(totals[1], 1)
    one, two = discounts(*totals[2:6]), discounts(*totals[6:10])
    two[1] = 1.0
    n_cut = one[1] * totals[2] + one[2] * totals[3] + one[3] * (totals[0] - totals[2] - totals[3])

    def run(rows: Iterable) -> Iterator[tuple]:
        for (body,), (of_pairs, sums_of_words) in rows:
            chunk = Chunk(body, counted=True)
            words, pairs = chunk.words, chunk.pairs
            count, _ = evidence(of_pairs)
            sums = np.concatenate([np.stack(_unzip(b, *[5] * SUMS)) for b in sums_of_words], 1).astype(np.int64)
            if len(count) != len(pairs) or sums.shape[1] != len(words):
                raise RuntimeError("the documents changed between two readings")
            by_itself = np.maximum(sums[0] - one[np.minimum(sums[0], 3)], 0) / n_pairs + n_cut / n_pairs / n_words
            rest = np.where(sums[1] > 0, (sums[2:] * two[1:, None]).sum(0) / np.maximum(sums[1], 1), 1.0)
            kept = np.maximum(count - two[np.minimum(count, 3)], 0)
            for (doc_id, lang, out), (row, word, ahead, pair) in zip(chunk.rows, chunk.places(), strict=True):
                own, inner = by_itself[word], ahead >= 0
                lead, p = ahead[inner], own.copy()
                p[inner] = kept[pair[inner]] / np.maximum(sums[1][lead], 1) + rest[lead] * own[inner]
                n = len(doc_id)
                columns = [doc_id.to_pylist(), lang.to_pylist(), *(x.tolist() for x in out.values()), np.bincount(row, np.log2(p), n).tolist(), np.bincount(row, np.log2(own), n).tolist()]
                yield from zip(*columns, strict=True)
            del chunk, words, pairs, count, sums, by_itself, rest, kept
            let_go()

    return run


def score_documents(docs: DataFrame, slice_bytes: int = 20 << 20) -> DataFrame:
    """Base counts of every document, and log2 of the probability of all its words by pairs and by themselves."""
    slices = max(8, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // slice_bytes))
    columns = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text")
    chunks = columns.rdd.mapPartitions(packed)
    parts = max(chunks.getNumPartitions(), 1)

    def itself(i: int) -> int:
        return i

    to_pairs = chunks.mapPartitionsWithIndex(send_pairs(slices)).partitionBy(slices, itself).mapPartitions(merge_pairs).partitionBy(parts, itself)
    if (more := to_pairs.getNumPartitions() - parts) > 0:  # where a session deals to more partitions than asked
        chunks = chunks.union(docs.sparkSession.sparkContext.parallelize([], more))
    few = max(8, slices // 8)
    merged = chunks.zip(to_pairs.mapPartitions(answers)).mapPartitionsWithIndex(send_words(few)).partitionBy(few, itself).mapPartitions(merge_words)
    totals = [sum(x) for x in zip(*merged.filter(lambda x: x[0] < 0).values().collect(), strict=True)] or [0] * 10
    to_words = merged.filter(lambda x: x[0] >= 0).partitionBy(parts, itself)
    rows = chunks.zip(to_pairs.union(to_words).mapPartitions(answers)).mapPartitions(score(totals))  # both are dealt alike, so nothing is shuffled again
    return docs.sparkSession.createDataFrame(rows, SCORES, verifySchema=False)
