"""Repeated passages across documents, by prefix-free parsing.

Windows of 50 bytes that are equal must meet in one task, so texts are dealt by
anchors first: a rolling hash of 20 bytes marks an anchor wherever it is the
least of the 31 that a window holds, so that equal windows have equal anchors.
An anchor's context is 30 bytes before it and 50 from it.

1. Anchors: which of them does another place have, too?
2. Contexts of these: is the same one in a document with a smaller doc_id? Then
   all windows around the anchor repeat. Of an anchor with several contexts,
3. the first document of each sends its bytes. A task parses its contexts
   prefix-free (pfp.py): rolling-hash triggers part them into phrases, suffix
   ranks of the dictionary and of the parse combine into corpus order, and
   there windows that begin with the same 50 bytes stand next to each other;
   the bytes themselves are compared. Of each such run all but those of the
   least doc_id repeat.

Contexts and anchors are compared by hashes of 40 bits at least beside the
anchor's own, windows by their bytes. Texts lie compressed in chunks of some MB
in a bucketed table of the shared folder; each phase reads them there, and only
hashes and answers are shuffled. A long text is a chunk of its own, hashed in
blocks.

Null texts are empty; texts under 50 bytes lose nothing. Rows without doc_id are
left out; rows that share one never remove bytes from each other. Other columns
are not read; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesnp import U64, hashes_of, mix, powers, prefix_hashes, text_runs
from .common import Scratch, keyed, pieces_for
from .pfp import equal_runs, suffix_order

LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM  # bytes of a window that may stand before its anchor
CHUNK_BYTES, BLOCK = 4 << 20, 1 << 20
TOGETHER = 1 << 15  # contexts whose suffixes are sorted at a time
_NONE = 255


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors, ascending, and the hashes of their bytes."""
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    for at in range(0, max(len(data) - LENGTH + 1, 0), BLOCK):
        place, found = _anchors_within(data[at : at + BLOCK + LENGTH - 1], bounds - at)
        fresh = np.searchsorted(place + at, places[-1][-1], "right") if len(places[-1]) else 0  # some lie in the block before, too
        places.append(place[fresh:] + at)
        hashes.append(found[fresh:])
        if not len(places[-1]):
            places.pop()
            hashes.pop()
    return np.concatenate(places), np.concatenate(hashes)


def _anchors_within(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of the windows that lie within these bytes and within one text."""
    n = len(data) - GRAM + 1
    none = np.zeros(0, np.int64), np.zeros(0, U64)
    if len(data) < LENGTH:
        return none
    sums = prefix_hashes(data)
    rolling = (sums[GRAM:] - sums[:-GRAM]) * powers(len(sums))[1][:n]
    low = U64((1 << 26) - 1)
    key = (rolling * U64(0xD6E8FEB86659FD93)) & ~low
    key |= low - np.arange(n, dtype=np.uint64)  # of equal ones the last
    least, width = key, 1
    while 2 * width <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    # windows that cross from one text into the next don't count
    crossing = np.zeros(len(least) + 1, np.int32)
    inner = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
    np.add.at(crossing, np.clip(inner - LENGTH + 1, 0, len(least)), 1)
    np.add.at(crossing, np.clip(inner, 0, len(least)), -1)
    least = least[np.cumsum(crossing)[:-1] == 0]
    if not len(least):
        return none
    chosen = least[np.r_[True, least[1:] != least[:-1]]]
    place = np.unique((low - (chosen & low)).astype(np.int64))
    return place, mix(rolling[place] + U64(GRAM))


def pack_chunk(doc_ids: np.ndarray, bounds: np.ndarray, data: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", len(doc_ids)) + doc_ids.astype("<i8").tobytes() + bounds.astype("<i8").tobytes() + data.tobytes())


class Chunk:
    """Some whole texts with what all phases derive from them in the same way."""

    def __init__(self, payload: bytes):
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(payload)
        n = struct.unpack_from("<I", raw)[0]
        self.doc_ids = np.frombuffer(raw, "<i8", n, 4)
        self.bounds = np.frombuffer(raw, "<i8", n + 1, 4 + 8 * n)
        self.data = np.frombuffer(raw, np.uint8, offset=12 + 16 * n)
        self.place, self.hash = anchors(self.data, self.bounds)
        self.distinct, self.which, self.times = np.unique(self.hash, return_inverse=True, return_counts=True)

    def contexts(self, shared: np.ndarray) -> None:
        """Entries: distinct (anchor, context) of the shared anchors, with the least doc_id of each."""
        chosen = (shared | (self.times > 1))[self.which]
        self.at, h = self.place[chosen], self.hash[chosen]
        row = np.searchsorted(self.bounds, self.at, "right") - 1
        self.row, self.doc = row, self.doc_ids[row]
        self.low = np.maximum(self.at - REACH, self.bounds[row])
        self.high = np.minimum(self.at + LENGTH, self.bounds[row + 1])
        context = mix(hashes_of(self.data, self.low, self.high) + (self.at - self.low).astype(U64))
        order = np.lexsort((self.doc, context, h))
        h, context = h[order], context[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (context[1:] != context[:-1])] if len(h) else np.zeros(0, bool)
        self.first = order[new]  # an occurrence in the least document
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.entry_hash, self.entry_context, self.entry_doc = h[new], context[new], self.doc[self.first]

    def context_bytes(self, entries: np.ndarray) -> bytes:
        """The contexts' bytes, one behind the other."""
        at = self.first[entries]
        raw = self.data.data
        return b"".join([raw[i:j] for i, j in zip(self.low[at].tolist(), self.high[at].tolist(), strict=True)])


def _slices(hashes: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    """(part, first, stop) of ascending hashes, by equal ranges of hashes."""
    edges = np.array([min(-(-(i << 64) // parts), (1 << 64) - 1) for i in range(parts)], U64)
    cuts = np.r_[np.searchsorted(hashes, edges), len(hashes)].tolist()
    return [(i, a, b) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def _flags(replies: dict, phase: int, parts: int, hashes: np.ndarray, bits: int) -> np.ndarray:
    """A phase's answers to a chunk, one row of bits for each hash that it sent."""
    out = np.zeros((len(hashes), bits), bool)
    for part, a, b in _slices(hashes, parts):
        out[a:b] = np.unpackbits(np.frombuffer(replies[phase, part], np.uint8))[: (b - a) * bits].reshape(-1, bits)
    return out


def _five(x: np.ndarray) -> bytes:
    """The upper 40 bits of each hash."""
    return (x >> U64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _write_chunks(docs: DataFrame, scratch: Scratch, name: str, buckets: int) -> DataFrame:
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for first, data, bounds in text_runs(batch.column("text"), CHUNK_BYTES):
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "payload": pa.array([pack_chunk(ids[first : first + len(bounds) - 1], bounds, data)], pa.binary())})
                chunk += 1

    docs.mapInArrow(packed, "chunk long, payload binary").write.bucketBy(buckets, "chunk").option("path", scratch.path("chunks")).saveAsTable(name)
    return docs.sparkSession.table(name)


MESSAGE = "chunk long, part int, body binary"


def _message(chunk: int, part: int, body: bytes) -> dict:
    return {"chunk": chunk, "part": part, "body": body}


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("body", pa.binary())]))


def _send_anchors(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload"), strict=True):
                x = Chunk(payload.as_py())
                yield from _table([_message(chunk, i, _five(x.distinct[a:b])) for i, a, b in _slices(x.distinct, parts)]).to_batches()

    return run


def _answer_anchors(table: pa.Table) -> pa.Table:
    """One bit: another chunk has the anchor, too."""
    bodies = [_from_five(x.as_py()) for x in table.column("body")]
    _, which, times = np.unique(np.concatenate(bodies), return_inverse=True, return_counts=True)
    shared = np.split(times[which] > 1, np.cumsum([len(x) for x in bodies])[:-1])
    return _table([_message(c, p, np.packbits(s).tobytes()) for c, p, s in zip(table.column("chunk").to_pylist(), table.column("part").to_pylist(), shared, strict=True)])


def _opened(left: pa.Table, right: pa.Table, parts: int, phases: int) -> tuple[Chunk, np.ndarray | None, dict]:
    """The chunk of a co-group, brought to the state before the given phase."""
    x = Chunk(left.column("payload")[0].as_py())
    replies = {(p, i): b for p, i, b in zip(right.column("phase").to_pylist(), right.column("part").to_pylist(), right.column("body").to_pylist(), strict=True)}
    x.contexts(_flags(replies, 1, parts, x.distinct, 1)[:, 0])
    return x, _flags(replies, 2, parts, x.entry_hash, 2) if phases > 1 else None, replies


def _send_contexts(parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([])
        x, _, _ = _opened(left, right, parts, 1)
        out = []
        for i, a, b in _slices(x.entry_hash, parts):
            body = struct.pack("<I", b - a) + _five(x.entry_hash[a:b]) + _five(x.entry_context[a:b]) + x.entry_doc[a:b].astype("<i8").tobytes()
            out.append(_message(left.column("chunk")[0].as_py(), i, body))
        return _table(out)

    return run


def _answer_contexts(table: pa.Table) -> pa.Table:
    """Two bits: a smaller document has the context; the anchor has several, and this is the first of its kind."""
    h, c, d, sizes = [], [], [], []
    for body in table.column("body"):
        raw = body.as_py()
        n = struct.unpack_from("<I", raw)[0]
        h.append(_from_five(raw[4 : 4 + 5 * n]))
        c.append(_from_five(raw[4 + 5 * n : 4 + 10 * n]))
        d.append(np.frombuffer(raw, "<i8", n, 4 + 10 * n))
        sizes.append(n)
    h, c, d = np.concatenate(h), np.concatenate(c), np.concatenate(d)
    order = np.lexsort((d, c, h))
    hs, cs, ds = h[order], c[order], d[order]
    new_h = np.r_[True, hs[1:] != hs[:-1]]
    new_c = new_h | np.r_[True, cs[1:] != cs[:-1]]
    group = np.cumsum(new_c) - 1
    full = ds > ds[new_c][group]
    kinds = np.bincount(np.cumsum(new_h) - 1, new_c)[np.cumsum(new_h) - 1]
    flags = np.zeros((len(h), 2), bool)
    flags[order, 0], flags[order, 1] = full, ~full & (kinds > 1)
    cuts = np.cumsum(sizes)[:-1]
    return _table([_message(k, p, np.packbits(f.ravel()).tobytes()) for k, p, f in zip(table.column("chunk").to_pylist(), table.column("part").to_pylist(), np.split(flags, cuts), strict=True)])


def _send_bytes(parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        if not left.num_rows:
            return _table([])
        x, flags, _ = _opened(left, right, parts, 2)
        some = np.flatnonzero(flags[:, 1])
        press, out = zstandard.ZstdCompressor(level=1), []
        for i, a, b in _slices(x.entry_hash[some], parts):
            own = some[a:b]
            at, low, high = (v[x.first[own]] for v in (x.at, x.low, x.high))
            body = struct.pack("<I", b - a) + x.entry_hash[own].tobytes() + x.entry_doc[own].astype("<i8").tobytes() + (at - low).astype(np.uint8).tobytes() + (high - at).astype(np.uint8).tobytes() + x.context_bytes(own)
            out.append(_message(left.column("chunk")[0].as_py(), i, press.compress(body)))
        return _table(out)

    return run


def repeated_windows(h: np.ndarray, d: np.ndarray, left: np.ndarray, right: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context the first and last offset at which its window is in a smaller document; _NONE: none.

    h: anchors; d: documents; left, right: bytes before and from the anchor;
    data: the contexts' bytes, one behind the other.
    """
    low, high = np.full(len(h), _NONE, np.uint8), np.full(len(h), _NONE, np.uint8)
    order = np.argsort(h, kind="stable")
    starts = np.cumsum(left.astype(np.int64) + right) - (left.astype(np.int64) + right)
    kinds = np.r_[np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]]), len(h)] if len(h) else np.zeros(1, np.int64)
    at = 0
    while at < len(h):  # whole anchors, about TOGETHER contexts
        stop = int(kinds[min(np.searchsorted(kinds, at + TOGETHER, "right"), len(kinds) - 1)])
        own = order[at:stop]
        at = stop
        before, size = left[own].astype(np.int64), left[own].astype(np.int64) + right[own]
        ends = np.cumsum(size)
        bounds = np.r_[0, ends]
        text = data[np.repeat(starts[own] - bounds[:-1], size) + np.arange(bounds[-1])]
        count = np.maximum(size - LENGTH + 1, 0)  # windows of a context; offset 0 is REACH bytes before the anchor
        of = np.repeat(np.arange(len(own)), count)
        within = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        offset = within + REACH - before[of]
        fit = (offset >= 0) & (offset <= REACH)
        of, place, offset = of[fit], (bounds[:-1][of] + within)[fit], offset[fit]
        if not len(of):
            continue
        ranked = suffix_order(text, bounds, place)
        run = equal_runs(text, place[ranked], LENGTH)
        docs = d[own][of[ranked]]
        least = np.minimum.reduceat(docs, np.flatnonzero(np.r_[True, run[1:] != run[:-1]]))
        hit = ranked[docs > least[run]]
        first, last = np.full(len(own), _NONE, np.int64), np.full(len(own), -1, np.int64)
        np.minimum.at(first, of[hit], offset[hit])
        np.maximum.at(last, of[hit], offset[hit])
        low[own], high[own] = first, np.where(last < 0, _NONE, last)
    return low, high


def _answer_bytes(table: pa.Table) -> pa.Table:
    """Two bytes a context: the answers of repeated_windows()."""
    import zstandard

    press, h, d, left, right, raws, sizes = zstandard.ZstdDecompressor(), [], [], [], [], [], []
    for body in table.column("body"):
        raw = press.decompress(body.as_py())
        n = struct.unpack_from("<I", raw)[0]
        h.append(np.frombuffer(raw, U64, n, 4))
        d.append(np.frombuffer(raw, "<i8", n, 4 + 8 * n))
        left.append(np.frombuffer(raw, np.uint8, n, 4 + 16 * n))
        right.append(np.frombuffer(raw, np.uint8, n, 4 + 17 * n))
        raws.append(np.frombuffer(raw, np.uint8, offset=4 + 18 * n))
        sizes.append(n)
    answer = np.stack(repeated_windows(*map(np.concatenate, (h, d, left, right, raws))), 1)
    return _table([_message(k, p, x.tobytes()) for k, p, x in zip(table.column("chunk").to_pylist(), table.column("part").to_pylist(), np.split(answer, np.cumsum(sizes)[:-1]), strict=True)])


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _finish(parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return RESULT.empty_table()
        x, flags, replies = _opened(left, right, parts, 2)
        some = np.flatnonzero(flags[:, 1])
        low = np.full(len(flags), _NONE, np.int64)
        high = low.copy()
        for i, a, b in _slices(x.entry_hash[some], parts):
            answer = np.frombuffer(replies[3, i], np.uint8).reshape(-1, 2)
            low[some[a:b]], high[some[a:b]] = answer[:, 0], answer[:, 1]
        full = flags[x.entry, 0] | (x.doc > x.entry_doc[x.entry])
        part = ~full & (low[x.entry] != _NONE)
        start = np.r_[x.low[full], x.at[part] - REACH + low[x.entry][part]]
        end = np.r_[x.high[full], x.at[part] - REACH + high[x.entry][part] + LENGTH]
        depth = np.zeros(len(x.data) + 1, np.int32)
        np.add.at(depth, start, 1)
        np.add.at(depth, end, -1)
        gone = np.cumsum(depth, dtype=np.int32)[:-1] > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[x.bounds[:-1][x.bounds[:-1] < len(gone)]] |= gone[x.bounds[:-1][x.bounds[:-1] < len(gone)]]
        out = []
        for i, doc_id in enumerate(x.doc_ids.tolist()):
            a, b = int(x.bounds[i]), int(x.bounds[i + 1])
            removed = int(gone[a:b].sum())
            kept = x.data[a:b][~gone[a:b]] if removed else x.data[a:b]
            out.append({"doc_id": doc_id, "n_bytes": b - a, "n_removed": removed, "n_spans": int(begins[a:b].sum()), "kept_sha256": hashlib.sha256(kept.tobytes()).hexdigest()})
        return pa.Table.from_pylist(out, RESULT)

    return run


def remove_repeats(docs: DataFrame, part_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    docs = keyed(docs.select(F.col("doc_id").cast("long"), "text"), "text")
    parts = pieces_for(docs, part_bytes, least=4)
    buckets = min(100_000, max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # as many as Spark allows
    name = f"sparquill_chunks_{uuid.uuid4().hex}"
    chunks = _write_chunks(docs, scratch, name, buckets)

    def answered(sent: DataFrame, answer, phase: int) -> DataFrame:
        dealt = sent.repartition(parts, "part")  # as many tasks as parts, however many partitions the session asks for
        return scratch.table(dealt.groupBy("part").applyInArrow(answer, MESSAGE).withColumn("phase", F.lit(phase)), f"answers{phase}")

    def beside(replies: DataFrame, function, schema: str) -> DataFrame:
        return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(function, schema)

    replies = answered(chunks.mapInArrow(_send_anchors(parts), MESSAGE), _answer_anchors, 1)
    replies = replies.union(answered(beside(replies, _send_contexts(parts), MESSAGE), _answer_contexts, 2))
    replies = replies.union(answered(beside(replies, _send_bytes(parts), MESSAGE), _answer_bytes, 3))
    out = scratch.table(beside(replies, _finish(parts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "result")
    spark.sql(f"DROP TABLE {name}")
    for used in ("chunks", "answers1", "answers2", "answers3"):
        scratch.drop(used)
    return out
