"""Snapshots of documents: changes, versions, operations to apply."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, change and size difference between two snapshots of (doc_id, text, source).

    The hashes of the two sides are joined, not the texts.
    """
    side = lambda d, s: d.select("doc_id", F.sha2("text", 256).alias(f"h_{s}"), F.coalesce("source", F.lit("")).alias(f"m_{s}"), F.octet_length("text").alias(f"n_{s}"))
    x = side(old, "old").join(side(new, "new"), "doc_id", "full_outer")
    content, meta = F.col("h_old") != F.col("h_new"), F.col("m_old") != F.col("m_new")
    change = (
        F.when(F.col("h_old").isNull(), "added").when(F.col("h_new").isNull(), "deleted").when(content & meta, "multiple").when(content, "content_changed").when(meta, "metadata_changed").otherwise("no_change")
    )
    return x.select("doc_id", change.alias("change"), (F.coalesce("n_new", F.lit(0)) - F.coalesce("n_old", F.lit(0))).cast("long").alias("size_delta"))


def number_versions(snapshots: DataFrame) -> DataFrame:
    """Versions of each document: a new one wherever its text differs from the snapshot before."""
    w = Window.partitionBy("doc_id").orderBy("snapshot")
    hashed = snapshots.select("doc_id", "snapshot", F.sha2("text", 256).alias("hash"))
    starts = hashed.withColumn("new", F.coalesce((F.lag("hash").over(w) != F.col("hash")).cast("int"), F.lit(1)))
    return starts.where("new = 1").select("doc_id", "snapshot", F.row_number().over(w).alias("version"))


def first_operations(operations: DataFrame) -> DataFrame:
    """One operation a document, the first by time; those without a document stay."""
    w = Window.partitionBy("doc_id").orderBy("at")
    known = operations.where("doc_id IS NOT NULL").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    return known.unionByName(operations.where("doc_id IS NULL"))


def apply_operations(index: DataFrame, operations: DataFrame) -> DataFrame:
    """The index (doc_id, text, version) after add, update and delete operations, one a document."""
    x = index.join(operations.select("doc_id", "op", F.col("text").alias("new_text")), "doc_id", "full_outer").where("op IS NULL OR op <> 'delete'")
    changed = F.col("op").isNotNull() & (F.coalesce("new_text", F.lit("")) != F.coalesce("text", F.lit("")))
    version = F.when(F.col("version").isNull(), 1).when(changed, F.col("version") + 1).otherwise(F.col("version"))
    return x.select("doc_id", F.coalesce("new_text", "text").alias("text"), version.cast("long").alias("version"))


def chunk_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, change): chunks (doc_id, chunk_index, chunk) of two snapshots compared place by place."""
    side = lambda d, s: d.select("doc_id", "chunk_index", F.md5("chunk").alias(s))
    x = side(old, "a").join(side(new, "b"), ["doc_id", "chunk_index"], "full_outer")
    return x.select("doc_id", "chunk_index", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "changed").otherwise("same").alias("change"))


def deltas(old: DataFrame, new: DataFrame) -> DataFrame:
    """Of documents in both snapshots the difference in bytes, its share of the old size (1 at most), and how sure a change is."""
    x = old.select("doc_id", F.octet_length("text").alias("m"), F.sha2("text", 256).alias("a")).join(new.select("doc_id", F.octet_length("text").alias("n"), F.sha2("text", 256).alias("b")), "doc_id")
    share = F.least(F.coalesce(F.try_divide(F.abs(F.col("n") - F.col("m")).cast("double"), F.col("m")), F.lit(1.0)), F.lit(1.0))
    return x.select("doc_id", (F.col("n") - F.col("m")).cast("long").alias("delta"), F.round(share, 6).alias("share"), F.round(F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.7 + 0.3 * share), 6).alias("confidence"))


def version_summary(versions: DataFrame) -> DataFrame:
    """Bytes that each version (doc_id, version, size) adds to or takes from the one before."""
    before = F.coalesce(F.lag("size").over(Window.partitionBy("doc_id").orderBy("version")), F.lit(0))
    d = F.col("size") - before
    return versions.select("doc_id", "version", F.greatest(d, F.lit(0)).cast("long").alias("additions"), F.greatest(-d, F.lit(0)).cast("long").alias("deletions"))


def conflicts(current: DataFrame, expected: DataFrame) -> DataFrame:
    """Documents whose current version is not the expected one (doc_id, version)."""
    x = expected.select("doc_id", F.col("version").alias("expected")).join(current.select("doc_id", "version"), "doc_id")
    return x.where("expected <> version").select("doc_id", "expected", F.col("version").alias("found"))


def resolved(conflict_rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Conflicts with a status: resolved where a decision (doc_id) is made."""
    return conflict_rows.join(decisions.select("doc_id", F.lit("resolved").alias("status")), "doc_id", "left").withColumn("status", F.coalesce("status", F.lit("open")))


def ordered_batches(operations: DataFrame, size: int) -> DataFrame:
    """Operations (op_id, priority, at) by priority, then time, with the batch that each goes in; valid ones only: priority 10 at most."""
    rank = F.row_number().over(Window.partitionBy("priority").orderBy("at", "op_id")) - 1
    return operations.where(F.col("op_id").isNotNull() & (F.col("priority") <= 10)).select("op_id", "priority", rank.alias("place"), F.floor(rank / size).alias("batch"))


def as_of(log: DataFrame, at: int) -> DataFrame:
    """The state (doc_id, text) that a log (doc_id, step, op, text) leaves after a step: a rollback reads it so."""
    last = log.where(F.col("step") <= at).groupBy("doc_id").agg(F.max_by(F.struct("op", "text"), "step").alias("s"))
    return last.where("s.op <> 'delete'").select("doc_id", "s.text")


def integrity(docs: DataFrame, chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """Counts of documents whose hash is not their text's, chunks without a document, and versions after a gap; and the health these mean.

    docs: doc_id, text, hash; chunks: doc_id; versions: doc_id, version.
    """
    wrong = docs.agg(F.sum((F.sha2("text", 256) != F.col("hash")).cast("long")).alias("wrong_hashes"))
    orphans = chunks.join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    before = F.lag("version").over(Window.partitionBy("doc_id").orderBy("version"))
    gaps = versions.select((F.col("version") - F.coalesce(before, F.lit(0)) != 1).cast("long").alias("gap")).agg(F.sum("gap").alias("gaps"))
    x = wrong.join(orphans).join(gaps)  # one row each
    return x.select("wrong_hashes", "orphans", "gaps", F.when(F.col("wrong_hashes") + F.col("orphans") + F.col("gaps") > 0, "critical").otherwise("healthy").alias("health"))


def metadata_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys of metadata maps (doc_id, meta) that were added, removed and changed."""
    x = old.select("doc_id", F.col("meta").alias("a")).join(new.select("doc_id", F.col("meta").alias("b")), "doc_id")
    a, b = F.map_keys("a"), F.map_keys("b")
    joined = lambda ks: F.array_join(F.array_sort(ks), ",")
    changed = F.filter(F.array_intersect(a, b), lambda k: F.col("a")[k] != F.col("b")[k])
    return x.select("doc_id", joined(F.array_except(b, a)).alias("added"), joined(F.array_except(a, b)).alias("removed"), joined(changed).alias("changed"))
