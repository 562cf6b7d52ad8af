"""Keyed storage over tables: (entry_type, namespace, id, content, ...) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["entry_type", "namespace", "id"]


def keyed(store: DataFrame) -> DataFrame:
    """The store with an empty namespace in place of none."""
    return store.withColumn("namespace", F.coalesce("namespace", F.lit("")))


def list_keys(store: DataFrame, entry_type: str | None = None, namespace: str | None = None, prefix: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Keys that match, in order: a page of them."""
    x = keyed(store).select(*KEY)
    for column, value in (("entry_type", entry_type), ("namespace", namespace)):
        x = x if value is None else x.where(F.col(column) == value)
    x = x if prefix is None else x.where(F.startswith("id", F.lit(prefix)))
    x = x.orderBy(*KEY).offset(offset)
    return x if limit is None else x.limit(limit)


def get_many(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted keys (KEY and place), content null for misses."""
    return keyed(wanted).join(keyed(store).select(*KEY, "content"), KEY, "left").select("place", *KEY, "content")


def put_many(store: DataFrame, rows: DataFrame) -> DataFrame:
    """The store with these rows (KEY, place, content) in it; the last of a key wins."""
    last = keyed(rows).groupBy(*KEY).agg(F.max_by("content", "place").alias("content"))
    return keyed(store).select(*KEY, "content").join(last.select(*KEY), KEY, "left_anti").unionByName(last)


def delete_many(store: DataFrame, gone: DataFrame) -> DataFrame:
    return keyed(store).join(keyed(gone).select(*KEY), KEY, "left_anti")


def removed(store: DataFrame, gone: DataFrame) -> DataFrame:
    """How many rows delete_many() takes out."""
    return keyed(store).join(keyed(gone).select(*KEY), KEY, "left_semi").agg(F.count(F.lit(1)).alias("removed"))


def stats(store: DataFrame) -> DataFrame:
    """Entries of each type, at 1,024 bytes each."""
    return store.groupBy("entry_type").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * 1024).alias("bytes"))


def chunk_keys(chunks: DataFrame) -> DataFrame:
    """Chunks under the id of their document and place in it."""
    return chunks.withColumn("id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))


def remove_documents(docs: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without these documents (doc_id)."""
    ids = gone.select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_anti"), chunks.join(ids, "doc_id", "left_anti")


def index_stats(vectors: DataFrame) -> DataFrame:
    """Items, their dimensions and bytes at four each."""
    size = F.size("embedding").cast("long")
    return vectors.agg(F.count(F.lit(1)).alias("items"), F.max(size).alias("dimensions"), (F.count(F.lit(1)) * F.max(size) * 4).alias("bytes"))


def current(versions: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(at))
    return versions.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
