"""Reproducible shards: a keyed permutation of row numbers says where each row stands.

Rows are numbered by doc_id, nulls first, then by size and checksum of the text;
rows alike in all of these are the same to any reader, so their order is left to
where they lie in the input. A Feistel network permutes the numbers 0 to 4^k - 1
that cover the rows; numbers outside of the table are permuted again until they
fall within (cycle walking), which leaves a permutation of the rows. The place p
of a row gives its shard, p modulo their number, and its slot, p divided by it:
shards differ by one row at most and slots have no gaps, however large a group
of copies, a source or a key is, as no group is dealt together. Place and
inverse need the number of rows and the seed alone, no table.

Null texts count as none; an empty table gives no rows. All columns are kept,
but for those of the names that the operator gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, pieces_for

ROUNDS = 6
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x reaches every bit of the result."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _half_bits(rows: int) -> int:
    """Bits of each half, so that both together count all rows."""
    return max(1, (max(rows - 1, 1).bit_length() + 1) // 2)


def _round_keys(seed: int) -> np.ndarray:
    return _mixed(np.arange(1, ROUNDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed & (1 << 64) - 1))


def _feistel(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    mask = _U((1 << half) - 1)
    left, right = x >> _U(half), x & mask
    for key in keys:
        left, right = right, left ^ (_mixed(right + key) & mask)
    return left << _U(half) | right


def _unfeistel(x: np.ndarray, half: int, keys: np.ndarray) -> np.ndarray:
    mask = _U((1 << half) - 1)
    left, right = x >> _U(half), x & mask
    for key in keys[::-1]:
        left, right = right ^ (_mixed(left + key) & mask), left
    return left << _U(half) | right


def _walked(x: np.ndarray, rows: int, seed: int, step) -> np.ndarray:
    out, half, keys = np.asarray(x).astype(_U), _half_bits(rows), _round_keys(seed)
    todo = np.arange(len(out))
    while len(todo):  # at most every cycle's length; each turn leaves fewer than three quarters on average
        out[todo] = step(out[todo], half, keys)
        todo = todo[out[todo] >= _U(rows)]
    return out.astype(np.int64)


def place(numbers: np.ndarray, rows: int, seed: int = 0) -> np.ndarray:
    """Where rows of these numbers stand in the shuffled order of `rows` rows."""
    return _walked(numbers, rows, seed, _feistel)


def number_at(places: np.ndarray, rows: int, seed: int = 0) -> np.ndarray:
    """The row numbers that stand at these places: the inverse of place()."""
    return _walked(places, rows, seed, _unfeistel)


def row_at(shard: int, slot: int, rows: int, shards: int, seed: int = 0) -> int:
    """The number of the row in a slot of a shard."""
    return int(number_at(np.array([slot * shards + shard]), rows, seed)[0])


def numbered(docs: DataFrame, scratch: Scratch, order: list[str] | None = None) -> tuple[DataFrame, int]:
    """docs with row_number from 0 by these columns (doc_id, size and checksum), and how many rows there are.

    A range sort, written once: what a part adds to its rows' numbers is the
    count of the parts before it. The last key, the row's place in the input,
    parts even copies without doc_id among tasks.
    """
    text = F.coalesce("text", F.lit("")) if order is None else None
    keys = [F.col(k) for k in order] if order else [F.col("doc_id"), F.octet_length(text), F.crc32(text)]
    keys = {f"__key_{i}": k for i, k in enumerate([*keys, F.monotonically_increasing_id()])}
    ranged = docs.select("*", *(k.alias(name) for name, k in keys.items()))
    parts = [pieces_for(docs, 16 << 20, most=1 << 17)] if "text" in docs.columns else []  # rows without texts: as many as the session says
    ranged = ranged.repartitionByRange(*parts, *keys).sortWithinPartitions(*keys)
    within = F.monotonically_increasing_id()
    written = scratch.table(ranged.select(*docs.columns, F.shiftright(within, 33).alias("__part"), within.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")), "numbered")
    counts = written.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    bases = counts.select("__part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__base"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = written.join(F.broadcast(bases), "__part")  # one row a part: 131,072 at most, or what the session says
    return rows.select(*docs.columns, (F.col("__base") + F.col("__at")).alias("row_number")), total


def shuffled(docs: DataFrame, shards: int = 16, seed: int = 0, order: list[str] | None = None) -> DataFrame:
    """docs with shard and slot of every row, in place of columns of these names."""
    docs = docs.drop("shard", "slot", "row_number")
    rows, total = numbered(docs, Scratch(docs.sparkSession), order)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = place(batch.column("row_number").to_numpy(), total, seed)
            for name, values in (("shard", p % shards), ("slot", p // shards)):
                batch = batch.append_column(name, pa.array(values, pa.int64()))
            yield batch

    schema = StructType([*rows.schema.fields, StructField("shard", LongType()), StructField("slot", LongType())])
    return rows.mapInArrow(deal, schema).select(*docs.columns, F.col("shard").cast("int").alias("shard"), "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 0, rows_a_file: int = 1 << 20) -> None:
    """Writes the shards as Parquet folders shard=N, files of ascending slots; a shard's rows are dealt to tasks by their slots, so none has to hold a shard."""
    out = shuffled(docs, shards, seed).withColumn("__file", F.floor(F.col("slot") / rows_a_file))
    out.repartition("shard", "__file").sortWithinPartitions("shard", "slot").drop("__file").write.mode("overwrite").partitionBy("shard").parquet(path)


def assign(docs: DataFrame, shards: int = 16, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: another number of shards moves rows of all) of every document."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shuffled(slim, shards, seed, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
