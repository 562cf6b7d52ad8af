"""SuperMinHash signatures of sets of 64-bit hashes, many sets at a time.

Every element draws a random permutation of the slots, one place at a time;
at step j it offers j plus a fraction to the slot that its permutation puts
there, and a slot keeps its least offer. A set is done once no slot can still
sink: at step j, when all its slots are below j. The steps run over all sets
that are not done, so a long set takes a step or two and a short one more.
"""

from __future__ import annotations

import numpy as np

from .bytesnp import U64, mix

BLOCK = 1 << 20  # elements that make their first offer at a time


def signatures(elements: np.ndarray, rows: np.ndarray, n_rows: int, slots: int) -> np.ndarray:
    """Signatures as a matrix n_rows x slots of doubles; empty sets keep inf.

    elements: distinct hashes of each set; rows: the set of each, ascending.
    """
    table = np.full((n_rows, slots), np.inf)
    if not len(elements):
        return table
    flat = table.ravel()
    for at in range(0, len(elements), BLOCK):
        offer, pick = _offers(elements[at : at + BLOCK], 0, slots)
        np.minimum.at(flat, rows[at : at + BLOCK] * slots + pick, offer)
    keep = (table.max(axis=1) > 1)[rows]
    live, row = elements[keep], rows[keep]
    if not len(live):
        return table
    first = _offers(live, 0, slots)[1]
    order = np.tile(np.arange(slots, dtype=np.int16), (len(live), 1))
    every = np.arange(len(live))
    order[every, first] = 0
    order[:, 0] = first
    for step in range(1, slots):
        offer, pick = _offers(live, step, slots)
        every = np.arange(len(live))
        slot = order[every, pick].astype(np.int64)
        order[every, pick] = order[:, step]
        order[:, step] = slot
        np.minimum.at(flat, row * slots + slot, offer)
        keep = (table.max(axis=1) > step + 1)[row]
        if not keep.any():
            break
        if keep.sum() < 0.8 * len(keep):
            live, row, order = live[keep], row[keep], order[keep]
    return table


def _offers(elements: np.ndarray, step: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """What each element offers at a step, and the place from step on that its permutation swaps there."""
    x = mix(elements + U64(0x9E3779B97F4A7C15 * (step + 1) % 2**64))
    offer = step + (x >> U64(11)).astype(np.float64) * 2.0**-53
    return offer, step + ((mix(x ^ U64(0xD6E8FEB86659FD93)) >> U64(32)) * U64(slots - step) >> U64(32)).astype(np.int64)


def band_keys(table: np.ndarray, bands: int, width: int) -> np.ndarray:
    """A hash of each band of slots: n_rows x bands."""
    bits = np.ascontiguousarray(table[:, : bands * width]).view(U64).reshape(len(table), bands, width)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(table), 1))
    for i in range(width):
        out = mix(out * U64(0x9E3779B97F4A7C15) + bits[:, :, i])
    return out
