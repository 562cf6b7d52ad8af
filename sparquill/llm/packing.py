"""Best-fit packing of token sequences by a grouping genetic algorithm.

Texts become pieces of at most `capacity` tokens; full pieces are sequences as
they are. The others are dealt into shards of bounded size by a hash of their
document, and each shard is packed by several islands: small populations of
packings with their own seeds. A crossover injects whole well-filled bins of
one parent into the other, removes the bins that hold duplicates, and best-fits
the documents that this displaces; a mutation dissolves the worst-filled bins.
After each epoch every island's best packing migrates to the next island of the
ring, through a written table. An island stops at the lower bound, so that
shards that best fit alone solves cost nothing more. Last, the worst-filled
bins of many shards are packed together once, to close what the shards left.

Null texts are empty: an end id alone. Rows without doc_id are left out; rows
that repeat a doc_id and text are packed each, numbered by the order they are
met in. Other columns are not read; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesnp import text_runs
from .common import Scratch, keyed
from .tokens import encoder, with_ends

CAPACITY = 2048
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 3, 2, 6, 24
SHARD, MERGED = 16_384, 512  # pieces of a shard; shards whose worst bins are packed together
PIECES = "piece_id long, doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, capacity: int, tokenizer: str | None) -> DataFrame:
    """The pieces of every text; of longer ones the first is the shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for first, data, bounds in text_runs(batch.column("text")):
                ids, counts = with_ends(*enc.encode_run(data, bounds))
                rows = np.arange(first, first + len(counts))
                n = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                head = counts - (n - 1) * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                raw = memoryview(ids.astype("<u4").tobytes())
                at = (np.cumsum(counts) - counts)[row] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                doc_ids = batch.column("doc_id").take(pa.array(rows[row]))
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.mapInArrow(cut, PIECES.removeprefix("piece_id long, "))
    return rows.select(F.monotonically_increasing_id().alias("piece_id"), "*")


def best_fit(sizes: np.ndarray, capacity: int, free: list[int] | None = None, order: np.ndarray | None = None) -> tuple[np.ndarray, list[int]]:
    """Bins of the items, taken from large to small or in the given order, each into the fullest bin that holds it.

    free: room in bins that are there already, numbered from 0. Bins of equal
    room are kept in a stack for each room, so that an item looks through rooms
    only; a bit set over the rooms finds the next one at once.
    """
    room = list(free or [])
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = 0
    for i, r in enumerate(room):
        stacks[r].append(i)
        bits |= 1 << r
    out = np.empty(len(sizes), np.int64)
    for i in (np.argsort(-sizes, kind="stable") if order is None else order).tolist():
        size = int(sizes[i])
        above = bits >> size
        if above:
            r = size + (above & -above).bit_length() - 1
            bin_ = stacks[r].pop()
            if not stacks[r]:
                bits &= ~(1 << r)
        else:
            r, bin_ = capacity, len(room)
            room.append(capacity)
        out[i], room[bin_] = bin_, r - size
        stacks[r - size].append(bin_)
        bits |= 1 << (r - size)
    return out, room


def _fill(bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.bincount(bins, sizes).astype(np.int64)


def _refit(bins: np.ndarray, sizes: np.ndarray, gone: np.ndarray, capacity: int) -> np.ndarray:
    """The packing after the items of the bins marked gone are best-fitted anew."""
    out = gone[bins]
    names = np.cumsum(~gone) - 1
    fill = _fill(bins, sizes)
    placed, _ = best_fit(sizes[out], capacity, (capacity - fill[~gone]).tolist())
    new = names[bins]
    new[out] = placed
    return new


def _crossover(mother: np.ndarray, father: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """The mother with some of the father's best-filled bins."""
    fill = _fill(father, sizes)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.6))
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, max(1, len(good) // 4), replace=False)] = True
    injected = chosen[father]
    gone = np.zeros(mother.max() + 1, bool)
    gone[mother[injected]] = True  # these bins hold what is injected
    loose = gone[mother] & ~injected
    child = np.empty(len(mother), np.int64)
    names = np.cumsum(~gone) - 1
    kept = ~gone[mother]
    child[kept] = names[mother[kept]]
    base = int((~gone).sum())
    child[injected] = base + np.unique(father[injected], return_inverse=True)[1]
    both = kept | injected
    room = (capacity - _fill(child[both], sizes[both])).tolist() if both.any() else []
    child[loose], _ = best_fit(sizes[loose], capacity, room)
    return child


def _mutated(bins: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """The packing with some of its worst-filled bins dissolved, and a few others, so that their room can be traded."""
    fill = _fill(bins, sizes)
    gone = (fill <= np.quantile(fill, rng.uniform(0.02, 0.5))) & (fill < capacity)
    gone |= rng.random(len(fill)) < rng.uniform(0, 0.4)
    return _refit(bins, sizes, gone, capacity)


def fitness(bins: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then fuller ones beside emptier ones."""
    fill = _fill(bins, sizes) / capacity
    return -len(fill), float((fill**2).sum())


def evolve(sizes: np.ndarray, capacity: int, seed: int, elites: list[np.ndarray], generations: int = GENERATIONS, population: int = POPULATION) -> tuple[np.ndarray, int]:
    """An island's best packing after an epoch, and how many generations that took.

    elites: packings that came from other islands, and its own; an island
    without any starts from documents placed in random orders. The lower bound
    ends an epoch, after one generation at the earliest.
    """
    rng = np.random.default_rng(seed)
    bound = -(-int(sizes.sum()) // capacity)
    own = list(elites) or [best_fit(sizes, capacity, order=rng.permutation(len(sizes)))[0] for _ in range(population)]
    if len(sizes) < 2:
        return own[0], 0
    while len(own) < population:
        own.append(_mutated(own[len(own) % len(elites)], sizes, capacity, rng))
    for turn in range(1, generations + 1):
        own.sort(key=lambda x: fitness(x, sizes, capacity), reverse=True)
        own = own[:population]
        if turn > 1 and own[0].max() + 1 <= bound:
            return own[0], turn - 1
        i, j = sorted(rng.choice(len(own), 2, replace=False).tolist())
        own.append(_mutated(_crossover(own[i], own[j], sizes, capacity, rng), sizes, capacity, rng))
    return max(own, key=lambda x: fitness(x, sizes, capacity)), generations


def _epoch(capacity: int, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (shard, island, sizes, elites) in enumerate(zip(*(batch.column(k) for k in ("shard", "island", "sizes", "elites")), strict=True)):
                own = [np.frombuffer(x, "<i4").astype(np.int64) for x in elites.as_py() or []]
                seed = (shard.as_py() * ISLANDS + island.as_py()) * EPOCHS + number
                best, turns = evolve(sizes.values.to_numpy(), capacity, seed, own)
                done = [batch.column(k).slice(i, 1) for k in ("shard", "island")]
                yield pa.RecordBatch.from_arrays([*done, pa.array([turns], pa.int64()), pa.array([best.astype("<i4").tobytes()], pa.binary())], names=["shard", "island", "generations", "packing"])

    return run


def _bins_of(shards: DataFrame, n_shards: int, capacity: int, scratch: Scratch, name: str) -> DataFrame:
    """(shard, bin, piece_id, length, generations) after all epochs; shards: shard, ids, sizes."""
    start = shards.select("shard", "sizes", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    packed = turns = None
    for number in range(EPOCHS):
        if packed is None:
            now = start.withColumn("elites", F.array().cast("array<binary>"))
        else:  # each packing stays, and goes to the next island of the ring
            moved = packed.select("shard", "packing", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)))).alias("island"))
            now = start.join(moved.groupBy("shard", "island").agg(F.sort_array(F.collect_list("packing")).alias("elites")), ["shard", "island"])
        dealt = now.select("shard", "island", "sizes", "elites").repartition(min(n_shards * ISLANDS, 1 << 16), "shard", "island")
        packed = scratch.table(dealt.mapInArrow(_epoch(capacity, number), "shard long, island int, generations long, packing binary"), f"{name}_epoch{number}")
        own = packed.select("shard", "generations")
        turns = own if turns is None else turns.union(own)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, ids, sizes, packings, total in zip(*(batch.column(k) for k in ("shard", "ids", "sizes", "packings", "generations")), strict=True):
                lengths = sizes.values.to_numpy()
                options = [np.frombuffer(x, "<i4").astype(np.int64) for x in packings.as_py()]
                best = max(options, key=lambda x: fitness(x, lengths, capacity))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), shard.as_py())), pa.array(best), ids.values, sizes.values, pa.array(np.full(len(best), total.as_py()))], names=["shard", "bin", "piece_id", "length", "generations"])

    best = packed.groupBy("shard").agg(F.sort_array(F.collect_list("packing")).alias("packings")).join(turns.groupBy("shard").agg(F.sum("generations").alias("generations")), "shard")
    return shards.join(best, "shard").select("shard", "ids", "sizes", "packings", "generations").mapInArrow(spread, "shard long, bin long, piece_id long, length long, generations long")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    generations: how many the islands ran that packed the piece; 0 for full pieces, which are sequences as they are.
    """
    scratch = Scratch(docs.sparkSession)
    docs = keyed(docs.select(F.col("doc_id").cast("long"), "text"), "text")
    pieces = scratch.table(cut_pieces(docs, capacity, tokenizer), "pieces")
    short = pieces.where(F.col("length") < capacity).select("piece_id", "length")
    n_shards = max(1, round(short.count() / SHARD))

    def gathered(rows: DataFrame) -> DataFrame:
        rows = rows.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("length", "piece_id"))).alias("rows"))
        return rows.select("shard", F.col("rows.piece_id").alias("ids"), F.col("rows.length").alias("sizes"))

    shards = scratch.table(gathered(short.withColumn("shard", F.pmod(F.xxhash64("piece_id"), F.lit(n_shards)))), "shards")
    bins = scratch.table(_bins_of(shards, n_shards, capacity, scratch, "shards"), "bins")
    # what a shard could not fill: its one worst bin, and any bin under half
    fills = bins.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
    worst = fills.groupBy("shard").agg(F.min_by("bin", F.struct("fill", "bin")).alias("worst"))
    loose = fills.join(worst, "shard").where((F.col("bin") == F.col("worst")) | (F.col("fill") < capacity // 2)).select("shard", "bin")
    again = bins.join(loose, ["shard", "bin"], "left_semi").select(F.floor(F.col("shard") / MERGED).alias("shard"), "piece_id", "length")
    merged = scratch.table(gathered(again), "merged")
    last = scratch.table(_bins_of(merged, -(-n_shards // MERGED), capacity, scratch, "merged"), "last")
    settled = bins.join(loose, ["shard", "bin"], "left_anti").select("piece_id", "shard", "bin", F.lit(1).alias("kind"), "generations").union(last.select("piece_id", "shard", "bin", F.lit(2), "generations"))

    sequence = F.when(F.col("bin").isNull(), F.col("piece_id") * 4).otherwise((F.col("shard") * (1 << 20) + F.col("bin")) * 4 + F.col("kind"))
    placed = pieces.join(settled, "piece_id", "left").withColumn("sequence_id", sequence)
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "piece_id").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"), F.coalesce("generations", F.lit(0)).alias("generations"))
