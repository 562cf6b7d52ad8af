"""Token-id output: documents in doc_id order as patched frame-of-reference segments.

Null texts are empty; an empty text is its end id alone. Rows without doc_id
have no place in the order and are left out; rows that repeat a doc_id follow
each other, by text. Other columns are not read. No rows: no segments, no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pfor
from .bytesnp import text_runs
from .common import Scratch, keyed, pieces_for
from .tokens import encoder, with_ends

SEGMENTS = "part int, segment int, n_ids long, payload binary"


def write_segments(docs: DataFrame, path: str, tokenizer: str | None = None, percentile: float = 0.95, run_bytes: int = 4 << 20, task_bytes: int = 8 << 20) -> None:
    """Writes segment rows (part, segment, n_ids, payload) to path, as Parquet.

    Parts are ranges of doc_id; in a part, segments follow each other. A segment
    holds whole documents of about run_bytes of text.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, number = encoder(tokenizer), 0
        for batch in batches:
            doc_ids = batch.column("doc_id").to_numpy()
            part = batch.column("part")[0].as_py() if len(batch) else 0
            for first, data, bounds in text_runs(batch.column("text"), run_bytes):
                ids, counts = with_ends(*enc.encode_run(data, bounds))
                payload = pfor.encode_segment(doc_ids[first : first + len(counts)], counts, ids, percentile)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()), "payload": pa.array([payload], pa.binary())})
                number += 1

    rows = keyed(docs, "text").repartitionByRange(pieces_for(docs, task_bytes), "doc_id").sortWithinPartitions("doc_id", "text")
    rows.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(encode, SEGMENTS).write.mode("overwrite").parquet(path)


def read_documents(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the segments."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, payload in zip(batch.column("base").to_numpy(), batch.column("payload"), strict=True):
                doc_ids, counts, ids = pfor.decode_segment(payload.as_py())
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(counts)
                starts = ends - counts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(starts + base, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    # one short row a part and segment: first within parts, then over the parts' sums
    sizes = segments.select("part", "segment", "n_ids")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("part_base"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("own_base", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part").select("part", "segment", (F.col("own_base") + F.col("part_base")).alias("base"))
    return segments.join(bases, ["part", "segment"]).select("base", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the documents' ids to segments in the shared folder, and reads them back."""
    scratch = Scratch(docs.sparkSession)
    write_segments(docs, scratch.path("segments"), tokenizer)
    return read_documents(docs.sparkSession.read.schema(SEGMENTS).parquet(scratch.path("segments")))
