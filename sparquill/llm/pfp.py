"""Prefix-free parsing, and the suffix order that its dictionary and parse give together.

A rolling hash of W bytes makes a place a trigger if it is 0 modulo MODULUS,
whatever stands around it. Phrases run from a trigger, or the beginning of a
text, to the end of the next trigger, or of the text, so that each shares W
bytes with the next. The dictionary holds the distinct phrases, the parse the
phrases of every text in order.

No suffix of a phrase that is longer than W is the beginning of another, unless
a text ends there: a phrase ends at the first trigger after its start. So a
suffix of a text compares like the suffix of the phrase that it begins in and,
where these are equal, like the rest of the parse. Ranks of dictionary suffixes
and of parse suffixes, both by prefix doubling, order all suffixes of the texts
then: a corpus order in which repeated text is sorted once, in the dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .bytesnp import U64, mix, prefix_hashes, span_hashes

W, MODULUS = 4, 12
_SYMBOLS = 7  # bytes that a first key holds, nine bits each; 0 stands for an end


@dataclass
class Parse:
    """Phrases of texts in order: start, end, phrase number, and the text each is of."""

    start: np.ndarray
    end: np.ndarray
    number: np.ndarray
    text: np.ndarray
    last: np.ndarray  # is it its text's last
    dictionary: np.ndarray  # bytes of the distinct phrases, one behind the other
    dictionary_start: np.ndarray
    dictionary_last: np.ndarray


def triggers(data: np.ndarray) -> np.ndarray:
    """Where W bytes begin whose hash is 0 modulo MODULUS."""
    n = max(len(data) - W + 1, 0)
    gram = np.zeros(n, np.uint32)
    for j in range(W):
        gram |= data[j : j + n].astype(np.uint32) << np.uint32(8 * j)
    return np.flatnonzero((gram * np.uint32(0x9E3779B1) >> np.uint32(15)) % np.uint32(MODULUS) == 0)


def parse(data: np.ndarray, bounds: np.ndarray) -> Parse:
    """The dictionary and the parse of the texts between the bounds."""
    sums = prefix_hashes(data)
    place = triggers(data)
    text = np.searchsorted(bounds, place, "right") - 1
    place = place[place + W <= bounds[text + 1]]
    start = np.union1d(bounds[:-1][np.diff(bounds) > 0], place)
    text = np.searchsorted(bounds, start, "right") - 1
    last = np.r_[text[1:] != text[:-1], True] if len(text) else np.zeros(0, bool)
    end = np.where(last, bounds[text + 1], np.r_[start[1:], 0] + W)
    key = mix(span_hashes(sums, start, end) + last.astype(U64))
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    length = (end - start)[first]
    ends = np.cumsum(length)
    places = np.repeat(start[first] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
    return Parse(start, end, number, text, last, data[places], ends - length, last[first])


def _first_ranks(key: np.ndarray) -> np.ndarray:
    """For each key how many are smaller."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(key) else np.zeros(0, bool)
    rank = np.empty(len(key), np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return rank


def _doubled(rank: np.ndarray, left: np.ndarray, step: int) -> np.ndarray:
    """Ranks by the pairs of ranks at a place and step further on, where something is left there.

    A rank is the number of smaller ones, so only places that share theirs are
    sorted again, and of these only such as share it with one that goes on.
    """
    open_ = np.zeros(len(rank), bool)
    open_[rank[left > step]] = True
    open_ &= np.bincount(rank, minlength=len(rank)) > 1
    tied = np.flatnonzero(open_[rank])
    if not len(tied):
        return rank
    beyond = np.zeros(len(tied), np.int64)
    some = np.flatnonzero(left[tied] > step)
    beyond[some] = rank[tied[some] + step] + 1
    key = (rank[tied] << 32) | beyond
    order = np.argsort(key)
    group, ordered = rank[tied[order]], key[order]
    where = np.arange(len(order))
    base = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], where, 0))
    first = np.maximum.accumulate(np.where(np.r_[True, ordered[1:] != ordered[:-1]], where, 0))
    out = rank.copy()
    out[tied[order]] = group + first - base
    return out


def dictionary_ranks(p: Parse) -> np.ndarray:
    """The rank of the suffix at each place of the dictionary, up to its phrase's end; equal suffixes share one."""
    n = len(p.dictionary)
    ends = np.r_[p.dictionary_start[1:], n]
    left = np.repeat(ends, np.diff(np.r_[p.dictionary_start, n])) - np.arange(n)
    symbols = np.r_[p.dictionary.astype(np.int64) + 1, np.zeros(_SYMBOLS, np.int64)]
    key = np.zeros(n, np.int64)
    for j in range(_SYMBOLS):
        key <<= 9
        key |= symbols[j : j + n]
    over = np.flatnonzero(left < _SYMBOLS)
    cut = 9 * (_SYMBOLS - left[over])
    key[over] = (key[over] >> cut) << cut  # what stands beyond the end counts as 0
    rank, step = _first_ranks(key), _SYMBOLS
    while step < left.max(initial=0):
        rank = _doubled(rank, left, step)
        step *= 2
    return rank


def parse_ranks(p: Parse, suffix_rank: np.ndarray) -> np.ndarray:
    """The rank, from 1, of the rest of its text's parse at each phrase."""
    phrase = 2 * suffix_rank[p.dictionary_start] + ~p.dictionary_last  # where a text ends comes first
    rank = _first_ranks(phrase[p.number])
    n = len(rank)
    ends = np.flatnonzero(p.last) + 1
    left = ends[np.searchsorted(ends, np.arange(n), "right")] - np.arange(n)
    step = 1
    while step < left.max(initial=0):
        rank = _doubled(rank, left, step)
        step *= 2
    return rank + 1


def suffix_order(data: np.ndarray, bounds: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The order of the suffixes at these places, each up to the end of its text."""
    p = parse(data, bounds)
    in_dictionary = dictionary_ranks(p)
    in_parse = np.r_[parse_ranks(p, in_dictionary), 0]
    phrase = np.searchsorted(p.start, places, "right") - 1
    rest = np.where(p.last[phrase], 0, in_parse[phrase + 1])
    own = in_dictionary[p.dictionary_start[p.number[phrase]] + places - p.start[phrase]]
    return np.argsort((own << 32) | rest, kind="stable")


def equal_runs(data: np.ndarray, ordered: np.ndarray, length: int) -> np.ndarray:
    """For places in suffix order, a number that is shared where `length` bytes, 8 at least, are the same."""
    if not len(ordered):
        return np.zeros(0, np.int64)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    eight = np.zeros(len(data), U64)
    for j in range(8):
        eight |= padded[j : j + len(data)].astype(U64) << U64(8 * j)
    same = np.ones(len(ordered) - 1, bool)
    for at in [*range(0, length - 7, 8), length - 8]:
        word = eight[ordered + at]
        same &= word[1:] == word[:-1]
    return np.r_[0, np.cumsum(~same)]
