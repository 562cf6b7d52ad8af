"""Near-duplicate documents: SuperMinHash signatures, bands, checks on full sets, components.

A document's set holds its distinct shingles of consecutive words; a text with
fewer words is one shingle. Documents with equal sets form a class, which its
least doc_id stands for from then on. Bands of the signatures put these into
buckets. Two rounds find the links of a bucket without listing its pairs:

1. Every member is compared with the bucket's least one.
2. Of buckets that still hold several components, the members outside one of
   them are set against all others, block by block: long signatures (512
   slots of a byte) are compared, and pairs that come within four standard
   deviations of the threshold go on, once for all buckets they share.

In both rounds full sets decide. A class that shares no link stays alone. Two
sets at the threshold of 0.85 miss each other with a chance of 5e-7 (25 bands
of 5 slots), or 3e-5 where only the second round sets them side by side.

Null and empty texts, and texts without words, have empty sets and no links.
Rows without doc_id are left out; rows that share one count as one document's.
Other columns are not read; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesnp import U64, hashes_of, lowered, mix, text_runs, word_spans
from .common import Scratch, join_sizes, keyed
from .components import components
from .superminhash import band_keys, signatures

BANDS, WIDTH = 25, 5
SHORT, LONG = 128, 512
FEW = 2_000_000  # candidate ids (8 bytes each) that may be broadcast; more are joined by a shuffle
LEFT_BLOCK, RIGHT_BLOCK = 128, 512
SHORT_RUN, LONG_RUN = 1 << 18, 1 << 17  # bytes of text whose words each hold a permutation of so many slots at once


def shingle_sets(data: np.ndarray, bounds: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, one row behind the other, and how many each has."""
    data = lowered(data)
    start, end, row = word_spans(data, bounds)
    h = hashes_of(data, start, end)
    rows = len(bounds) - 1
    first = np.searchsorted(row, np.arange(rows + 1))
    length = np.minimum(np.diff(first), words)  # words of a shingle of each row
    ends = np.searchsorted(row, row, "right")
    begins = np.arange(len(h)) + length[row] <= ends
    code = np.full(len(h), 1, U64)
    for i in range(words):
        step = code.copy()
        step[: len(h) - i] = mix(code[: len(h) - i] * U64(0x9E3779B97F4A7C15) + h[i:])
        code = np.where(i < length[row], step, code)
    code, owner = code[begins], row[begins]
    cuts = np.searchsorted(owner, np.arange(rows + 1))
    sets = [np.unique(code[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return (np.concatenate(sets) if sets else code), np.array([len(x) for x in sets], np.int64)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values.view(np.int64)))


def sign(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, a digest of the set in two halves, and band keys."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, bounds in text_runs(batch.column("text"), SHORT_RUN):
                elements, counts = shingle_sets(data, bounds, words)
                rows = np.repeat(np.arange(len(counts)), counts)
                halves = []
                for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                    sums = np.zeros(len(elements) + 1, U64)
                    np.cumsum(mix(elements ^ U64(salt)), out=sums[1:])
                    ends = np.cumsum(counts)
                    halves.append((sums[ends] - sums[ends - counts]).view(np.int64))
                keys = band_keys(signatures(elements, rows, len(counts), SHORT), BANDS, WIDTH)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(counts)), pa.array(counts), *map(pa.array, halves), _lists(keys.ravel(), np.full(len(counts), BANDS))], names=["doc_id", "n_shingles", "d1", "d2", "bands"])

    return docs.mapInArrow(signed, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, the whole set, and the long signature in bytes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, bounds in text_runs(batch.column("text"), LONG_RUN):
                elements, counts = shingle_sets(data, bounds, words)
                table = signatures(elements, np.repeat(np.arange(len(counts)), counts), len(counts), LONG)
                small = (mix(table.view(U64)) >> U64(56)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(counts)), pa.array(counts), _lists(elements, counts), pa.array([x.tobytes() for x in small], pa.binary())], names=["doc_id", "n", "shingles", "long_sig"])

    return docs.mapInArrow(made, "doc_id long, n long, shingles array<long>, long_sig binary")


def _alike(x: str | Column, y: str | Column, percent: int) -> Column:
    """Can sets of these sizes reach the threshold?"""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets reach the threshold."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("doc_id").alias(side), F.col("n").alias(f"n{side}")), side)
    pairs = pairs.where(_alike("na", "nb", percent))
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("doc_id").alias(side), F.col("n").alias(f"n{side}"), F.col("shingles").alias(f"s{side}")), [side, f"n{side}"])
    shared = F.size(F.array_intersect("sa", "sb"))
    return pairs.where(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b").distinct()


def _block_pairs(percent: int):
    """Compares the members of two blocks of a bucket; gives (a, b) that may be links."""
    margin = percent / 100 - 4 * np.sqrt(percent / 100 * (1 - percent / 100) / LONG)

    def columns(rows: pa.ListScalar) -> tuple[np.ndarray, ...]:
        x = rows.values
        n = len(x)
        bands = x.field("bands").flatten().to_numpy().reshape(n, BANDS)
        sig = np.frombuffer(b"".join(x.field("long_sig").to_pylist()), np.uint8).reshape(n, LONG)
        return (*(x.field(k).to_numpy() for k in ("doc_id", "comp", "n")), bands, sig)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for key, pivot, left, right in zip(*(batch.column(k) for k in ("key", "pivot", "left", "right")), strict=True):
                key, pivot = key.as_py(), pivot.as_py()
                doc, comp, n, bands, sig = columns(left)
                docs, comps, ns, all_bands, sigs = columns(right)
                for i in range(len(doc)):
                    ok = (comps != comp[i]) & (100 * np.minimum(ns, n[i]) >= percent * np.maximum(ns, n[i])) & (docs != pivot) & (doc[i] != pivot)
                    at = np.flatnonzero(ok)
                    at = at[(sigs[at] == sig[i]).sum(1) >= margin * LONG]
                    if len(at):  # only in the first bucket that both are in
                        same = all_bands[at] == bands[i]
                        at = at[all_bands[at, same.argmax(1)] == key]
                        found += [(min(doc[i], x), max(doc[i], x)) for x in docs[at].tolist()]
            yield pa.RecordBatch.from_pydict({"a": pa.array([int(x[0]) for x in found], pa.int64()), "b": pa.array([int(x[1]) for x in found], pa.int64())})

    return compare


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; links: Jaccard of percent / 100 or more."""
    scratch = Scratch(docs.sparkSession)
    docs = keyed(docs.select(F.col("doc_id").cast("long"), "text"), "text")
    signed = scratch.table(sign(docs, words), "signed")
    some = signed.where("n_shingles > 0")
    classes = scratch.table(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("of_class")), "classes")
    repeated = classes.where("of_class > 1").select("d1", "d2", "rep", "of_class")
    first_ids = join_sizes(some, repeated, ["d1", "d2"], "of_class").where("doc_id = rep").select(*some.columns)
    alone = some.join(classes.where("of_class = 1").select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    heads = scratch.table(alone.unionByName(first_ids.dropDuplicates(["doc_id"])).select("doc_id", "bands"), "heads")
    placed = heads.select("doc_id", F.explode("bands").alias("key"))
    pivots = scratch.table(placed.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1"), "pivots")
    members = scratch.table(join_sizes(placed, pivots, ["key"], "size"), "members")

    ids = members.select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= FEW else ids
    sets = scratch.table(full_sets(docs.join(ids, "doc_id", "left_semi").select("doc_id", "text"), words), "sets")

    first = members.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = scratch.table(confirmed(first, sets, percent), "links")
    roots = components(links, scratch, "near")

    known = members.join(roots.toDF("doc_id", "root"), "doc_id", "left").select("key", "pivot", "size", "doc_id", F.coalesce("root", "doc_id").alias("comp"))
    known = scratch.table(known, "known")
    several = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("size").alias("of"), F.count(F.lit(1)).alias("n_all")).where("low < high and of > 2")
    several = scratch.table(several, "several")
    left_over = join_sizes(known.drop("size"), several, ["key"], "n_all")
    n_out = left_over.where("comp <> low").groupBy("key").agg(F.count(F.lit(1)).alias("n_out"), F.max("n_all").alias("n_all"))
    left_over = join_sizes(left_over.drop("n_all"), scratch.table(n_out, "n_out"), ["key"], "n_all")
    bands = heads
    left_over = scratch.table(left_over.select("key", "pivot", "doc_id", "comp", "low", "n_all", "n_out"), "left_over")
    need = left_over.select("doc_id").distinct()
    detail = scratch.table(need.join(sets.select("doc_id", "n", "long_sig"), "doc_id").join(bands, "doc_id").select("doc_id", "n", "long_sig", "bands"), "detail")
    full = left_over.join(detail, "doc_id")
    member = F.struct("doc_id", "comp", "n", "bands", "long_sig")
    spread = F.xxhash64("doc_id")
    left = full.where("comp <> low").groupBy("key", "pivot", F.pmod(spread, F.ceil(F.col("n_out") / LEFT_BLOCK)).alias("lb")).agg(F.collect_list(member).alias("left"))
    right = full.groupBy("key", F.pmod(spread, F.ceil(F.col("n_all") / RIGHT_BLOCK)).alias("rb")).agg(F.collect_list(member).alias("right"))
    again = left.join(right, "key").select("key", "pivot", "left", "right").mapInArrow(_block_pairs(percent), "a long, b long")
    more = scratch.table(confirmed(again.distinct(), sets, percent), "more_links")
    if not more.isEmpty():
        merged = more
        for side in ("a", "b"):
            merged = merged.join(roots.toDF(side, f"root_{side}"), side, "left")
        merged = merged.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        roots = components(roots.toDF("a", "b").union(merged), scratch, "all")

    rooted = classes.where("of_class > 1").join(roots.toDF("rep", "root"), "rep", "left").select("d1", "d2", F.coalesce("root", "rep").alias("class_root"), "of_class")
    rooted = scratch.table(rooted, "rooted")
    named = join_sizes(some.select("doc_id", "n_shingles", "d1", "d2"), rooted, ["d1", "d2"], "of_class", "left")  # classes of one by their own id
    named = named.join(roots.toDF("doc_id", "root"), "doc_id", "left").unionByName(signed.where("n_shingles = 0").select("doc_id", "n_shingles"), allowMissingColumns=True)
    component = F.coalesce("class_root", "root", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stand for their component, columns as they are; rows without doc_id stay."""
    kept = near_duplicates(docs, words, percent).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    plain, columns = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), docs.columns
    own = F.col(f"c{columns.index('doc_id')}").cast("long")
    found = plain.join(kept, own == F.col("kept_id"), "left").where(F.col("kept_id").isNotNull() | own.isNull())
    return found.drop("kept_id").toDF(*columns)
