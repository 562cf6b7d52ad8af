"""Patched frame-of-reference blocks of token ids.

A segment holds the ids of some documents in 128-id blocks. A block stores its
minimum, the rest packed at the width that a percentile of its values needs,
and those that need more in an exception list; an index has the start of each
block, so that any range of ids is read without what stands before it.

Layout, little-endian: magic "PFR1", u32 ids, u32 blocks, u32 documents; then
i64 doc_id and u32 ids for each document; then u32 start (from the first block)
for each block and its end; then the blocks: u32 minimum, u8 width, u8
exceptions, 16 * width bytes of values (low bits first), u8 places and u32
values of the exceptions. The last block is filled up with its last id.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 128
MAGIC = b"PFR1"


def _widths(rest: np.ndarray, percentile: float) -> np.ndarray:
    """Bits that the percentile value of each block needs."""
    rank = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    return np.ceil(np.log2(np.partition(rest, rank, axis=1)[:, rank].astype(np.float64) + 1)).astype(np.int64)


def encode_segment(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, percentile: float = 0.95) -> bytes:
    """The segment of these documents; ids: uint32, one document behind the other."""
    blocks = -(-len(ids) // BLOCK)
    head = MAGIC + struct.pack("<III", len(ids), blocks, len(doc_ids)) + doc_ids.astype("<i8").tobytes() + counts.astype("<u4").tobytes()
    if not blocks:
        return head + struct.pack("<I", 0)
    table = np.full(blocks * BLOCK, ids[-1], np.uint32)
    table[: len(ids)] = ids
    table = table.reshape(blocks, BLOCK)
    low = table.min(axis=1)
    rest = table - low[:, None]
    width = _widths(rest, percentile)
    over = rest >> width.astype(np.uint32)[:, None] > 0
    exceptions = over.sum(axis=1)
    sizes = 6 + 16 * width + 5 * exceptions
    starts = np.r_[0, np.cumsum(sizes)]
    out = np.zeros(starts[-1], np.uint8)
    at = starts[:-1]
    out[at[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(blocks, 4)
    out[at + 4], out[at + 5] = width, exceptions
    for w in np.unique(width[width > 0]).tolist():
        some = np.flatnonzero(width == w)
        bits = np.empty((len(some), BLOCK, w), np.uint8)
        for b in range(w):
            bits[:, :, b] = (rest[some] >> np.uint32(b)) & np.uint32(1)
        packed = np.packbits(bits.reshape(len(some), -1), axis=1, bitorder="little")
        out[at[some][:, None] + 6 + np.arange(16 * w)] = packed
    block, place = np.nonzero(over)
    if len(block):
        rank = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        base = at[block] + 6 + 16 * width[block]
        out[base + rank] = place
        values = rest[over].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(base + exceptions[block] + 4 * rank)[:, None] + np.arange(4)] = values
    return head + starts.astype("<u4").tobytes() + out.tobytes()


def read_index(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """doc_ids, ids of each, block starts, where the blocks begin, ids in all."""
    if raw[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n, blocks, docs = struct.unpack_from("<III", raw, 4)
    at = 16
    doc_ids = np.frombuffer(raw, "<i8", docs, at)
    counts = np.frombuffer(raw, "<u4", docs, at + 8 * docs).astype(np.int64)
    at += 12 * docs
    starts = np.frombuffer(raw, "<u4", blocks + 1, at).astype(np.int64)
    return doc_ids, counts, starts, at + 4 * (blocks + 1), n


def decode_blocks(raw: bytes, first: int, stop: int) -> np.ndarray:
    """The ids of the blocks first to stop - 1, uint32."""
    _, _, starts, base, n = read_index(raw)
    data = np.frombuffer(raw, np.uint8)
    at = base + starts[first:stop]
    blocks = len(at)
    low = data[at[:, None] + np.arange(4)].copy().view("<u4").ravel()
    width, exceptions = data[at + 4].astype(np.int64), data[at + 5].astype(np.int64)
    rest = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        some = np.flatnonzero(width == w)
        bits = np.unpackbits(data[at[some][:, None] + 6 + np.arange(16 * w)], axis=1, bitorder="little").reshape(len(some), BLOCK, w)
        values = np.zeros((len(some), BLOCK), np.uint32)
        for b in range(w):
            values |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
        rest[some] = values
    if exceptions.any():
        block = np.repeat(np.arange(blocks), exceptions)
        rank = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        where = at[block] + 6 + 16 * width[block]
        place = data[where + rank]
        rest[block, place] = data[(where + exceptions[block] + 4 * rank)[:, None] + np.arange(4)].copy().view("<u4").ravel()
    return (rest + low[:, None]).ravel()[: n - first * BLOCK]


def decode_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, ids of each, and all ids one behind the other."""
    doc_ids, counts, starts, _, n = read_index(raw)
    return doc_ids, counts, decode_blocks(raw, 0, len(starts) - 1) if n else np.zeros(0, np.uint32)


def decode_document(raw: bytes, place: int) -> np.ndarray:
    """The ids of one document of the segment, from its own blocks only."""
    _, counts, _, _, _ = read_index(raw)
    start = int(counts[:place].sum())
    stop = start + int(counts[place])
    if start == stop:
        return np.zeros(0, np.uint32)
    first = start // BLOCK
    return decode_blocks(raw, first, -(-stop // BLOCK))[start - first * BLOCK : stop - first * BLOCK]
