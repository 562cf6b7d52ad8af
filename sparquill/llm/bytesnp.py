"""Vectorised work on the UTF-8 bytes of Arrow text columns.

Texts are handled in runs of whole rows of about ``limit`` bytes, so that the
temporary arrays stay small; one row that is longer forms a run of its own, and
hashes of its spans are then taken in blocks. Nulls count as empty texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, n of them at least."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    size = 1 << max(n - 1, 1).bit_length()
    up, down = np.full(size, _BASE, U64), np.full(size, _INVERSE, U64)
    up[0] = down[0] = 1
    made = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if size <= 1 << 22:
        _powers = made
    return made


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hashes() takes the hash of any byte span."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes in [start, end): equal bytes, equal hashes."""
    down = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def _long_hash(data: np.ndarray, block: int) -> np.uint64:
    """span_hashes() of all the bytes, block by block."""
    total = 0
    for at in range(0, len(data), block):
        part = data[at : at + block]
        total += int((_BYTE[part] * powers(len(part))[0][: len(part)]).sum()) * pow(int(_BASE), at, 1 << 64)
    return mix(np.array([(total + len(data)) % (1 << 64)], U64))[0]


def hashes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """span_hashes() of spans in ascending order of their starts, with temporary arrays of 2 * block places at most."""
    if len(data) <= 2 * block:
        return span_hashes(prefix_hashes(data), start, end)
    out = np.empty(len(start), U64)
    cuts = np.searchsorted(start, np.arange(0, len(data) + block, block)).tolist()
    for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if i == j:
            continue
        at = k * block
        s, e = start[i:j] - at, end[i:j] - at
        near = e <= 2 * block
        if near.any():
            out[i:j][near] = span_hashes(prefix_hashes(data[at : at + int(e[near].max())]), s[near], e[near])
        for x in np.flatnonzero(~near).tolist():
            out[i + x] = _long_hash(data[start[i + x] : end[i + x]], block)
    return out


def text_runs(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds of the rows in them: one more than rows)."""
    if not len(column):
        return
    if column.null_count:
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        yield row, data[bounds[row] : bounds[stop]], bounds[row : stop + 1] - bounds[row]
        row = stop


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words: runs of bytes but space and 09-0D."""
    solid = ~SPACE[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~solid[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~solid[1:]
    start = np.flatnonzero(solid & (before | edge[:-1]))
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    return start, end, np.searchsorted(bounds, start, "right") - 1


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of flags within the bounds."""
    out = np.zeros(len(bounds) - 1, np.int64)
    some = np.diff(bounds) > 0
    if some.any():
        out[some] = np.add.reduceat(flags, bounds[:-1][some], dtype=np.int64)
    return out


def crc32_text(value: object) -> int:
    return zlib.crc32(str(value).encode())
