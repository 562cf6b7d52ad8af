"""Token ids of whole texts by a public tokenizer file, with a memory of pieces.

A byte-level BPE text can be cut, with no change of its ids, where a run of
white space begins and where an ASCII letter meets an ASCII sign. The pieces
between such cuts repeat; each worker keeps the ids of those it has met, by a
64-bit hash in sorted arrays of bounded size, and only new ones reach the
tokenizers library, many at a time. Rows with white space outside ASCII, where
the first rule is not enough, and rows that hold the string of a special token,
which the library takes out before it parts a text, are encoded in one go. Long
texts go block by block, parted where an ASCII character meets white space or a letter a sign, so
that memory grows with the ids alone; a text without such a place is one block.
"""

from __future__ import annotations

import os

import numpy as np

from .bytesnp import SPACE, U64, prefix_hashes, span_hashes

END_ID = 0
BLOCK = 1 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[:128] = ~_LETTER[:128] & ~SPACE[:128]
_encoders: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    """The place of the 50k byte-level vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def wide_space(data: np.ndarray) -> np.ndarray:
    """Places of white space outside ASCII: U+0085, A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000."""
    found = []
    at = np.flatnonzero(data[:-1] == 0xC2)
    found.append(at[np.isin(data[at + 1], (0x85, 0xA0))])
    if len(data) > 2:
        at = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3))
        code = (data[at].astype(np.int64) << 16) | (data[at + 1].astype(np.int64) << 8) | data[at + 2]
        spaces = [0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]
        found.append(at[np.isin(code, spaces)])
    return np.concatenate(found)


def places_of(raw: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin and end in raw, by their beginning; overlaps count."""
    starts, ends = [], []
    for word in words:
        at = raw.find(word)
        while at >= 0:
            starts.append(at)
            ends.append(at + len(word))
            at = raw.find(word, at + 1)
    order = np.argsort(starts, kind="stable")
    return np.array(starts, np.int64)[order], np.array(ends, np.int64)[order]


def long_text_blocks(data: np.ndarray, words: list[bytes] = ()) -> np.ndarray:
    """Bounds of blocks of about BLOCK bytes that can be encoded by themselves; none parts one of the words."""
    cuts = [0]
    starts, ends = places_of(data.tobytes(), words)
    within = np.zeros(len(data) + 1, bool)
    for a, b in zip(starts.tolist(), ends.tolist()):
        within[a + 1 : b] = True
    begins = np.zeros(len(data) + 1, bool)
    begins[starts] = True
    while len(data) - cuts[-1] > 2 * BLOCK:
        at = cuts[-1] + BLOCK
        while at < len(data):
            some = data[at - 1 : at + BLOCK]
            left, right = some[:-1], some[1:]
            here = slice(at, at + len(left))
            safe = np.flatnonzero((((left < 128) & ~SPACE[left] & SPACE[right]) | (_LETTER[left] & _SIGN[right]) | begins[here]) & ~within[here])
            if len(safe):
                cuts.append(at + int(safe[0]))
                break
            at += BLOCK
        else:
            break
    return np.array([*cuts, len(data)])


def gather(pool: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The spans of pool that begin at start, one behind the other."""
    ends = np.cumsum(count)
    if not len(ends) or not ends[-1]:
        return pool[:0]
    return pool[np.repeat(start - (ends - count), count) + np.arange(ends[-1])]


class Encoder:
    """Encodes texts as the tokenizers library does by default: the string of a special token in a text becomes that token."""

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        vocab = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)  # a token's characters stand for a byte each
        for token, number in vocab.items():
            self.bytes_of[number] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.zeros(0, U64), np.zeros(0, np.int64)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text, straight from the tokenizers library."""
        self.tokenizer.encode_special_tokens = False
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _encode_plain(self, text: str) -> np.ndarray:
        """The ids of pieces, in which strings of special tokens are ordinary text: rows that hold them don't use these."""
        self.tokenizer.encode_special_tokens = True
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one behind the other, and how many each has."""
        ids, counts = [], np.zeros(len(pieces), np.int64)
        for i in range(0, len(pieces), 256):
            some = pieces[i : i + 256]
            if any(SPACE[x[-1]] for x in some):
                each = [self._encode_plain(x.decode()) for x in some]
                counts[i : i + 256] = [len(x) for x in each]
                ids += each
                continue
            # a line feed ahead of what has no space ahead is a token of its own
            own = np.array([not SPACE[x[0]] for x in some])
            text = b"".join([b"\n" + x if o else x for x, o in zip(some, own, strict=True)])
            got = self._encode_plain(text.decode())
            sizes = np.array([len(x) for x in some]) + own
            ends = np.searchsorted(np.cumsum(self.bytes_of[got]), np.cumsum(sizes)) + 1
            first = np.r_[0, ends[:-1]]
            keep = np.ones(len(got), bool)
            keep[first[own]] = False
            ids.append(got[keep])
            counts[i : i + 256] = ends - first - own
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), counts

    def encode_run(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of a run of bytes, one behind the other, and how many each row has."""
        ids, counts, row = [], [], 0
        while row < len(bounds) - 1:
            stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + BLOCK, "right")) - 1)
            some = data[bounds[row] : bounds[stop]]
            if len(some) <= 2 * BLOCK:
                got, n = self._encode_rows(some, bounds[row : stop + 1] - bounds[row])
            else:  # one long row
                got, n = self._encode_rows(some, long_text_blocks(some, self.special))
                n = n.sum(keepdims=True)
            ids.append(got)
            counts.append(n)
            row = stop
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _encode_rows(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(data) > 2 * BLOCK:  # blocks of one text, one after the other
            each = [self._encode_block(data[a:b], np.array([0, b - a])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            return np.concatenate([x for x, _ in each]), np.concatenate([n for _, n in each])
        return self._encode_block(data, bounds)

    def _encode_block(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(bounds) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        odd = np.concatenate([wide_space(data), places_of(data.tobytes(), self.special)[0]]) if len(data) > 1 else []
        odd = np.unique(np.searchsorted(bounds, odd, "right") - 1) if len(odd) else []
        white = SPACE[data]
        cut = np.empty(len(data), bool)
        cut[0] = True
        cut[1:] = (white[1:] & ~white[:-1]) | (_LETTER[data[:-1]] & _SIGN[data[1:]])
        cut[bounds[:-1][bounds[:-1] < len(data)]] = True
        start = np.flatnonzero(cut)
        end = np.r_[start[1:], len(data)]
        row = np.searchsorted(bounds, start, "right") - 1
        hashes = span_hashes(prefix_hashes(data), start, end)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.most:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != distinct[inside]
        if new.any():
            raw = data.tobytes()
            ids, counts = self._encode_pieces([raw[start[i] : end[i]] for i in first[new].tolist()])
            self.start = np.r_[self.start, len(self.pool) + np.cumsum(counts) - counts]
            self.slots = np.insert(self.slots, at[new], np.arange(len(self.count), len(self.count) + len(counts)))
            self.count = np.r_[self.count, counts]
            self.pool = np.r_[self.pool, ids]
            self.keys = np.insert(self.keys, at[new], distinct[new])
            at = np.searchsorted(self.keys, distinct)
        slot = self.slots[at][which]
        if len(odd):
            slot = slot[~np.isin(row, odd)]
            row = row[~np.isin(row, odd)]
        each = self.count[slot]
        ids = gather(self.pool, self.start[slot], each)
        total = np.bincount(row, each, rows).astype(np.int64)
        if not len(odd):
            return ids, total
        parts = np.split(ids, np.cumsum(total)[:-1])
        for i in odd:
            parts[i] = self.encode(data[bounds[i] : bounds[i + 1]].tobytes().decode())
            total[i] = len(parts[i])
        return np.concatenate(parts), total


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder for the file; it outlives tasks."""
    path = path or default_tokenizer()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_ends(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with END_ID behind each row."""
    return np.insert(ids, np.cumsum(counts), END_ID).astype(np.uint32), counts + 1
