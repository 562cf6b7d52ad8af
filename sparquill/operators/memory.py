"""Conversation memory: (conv_id, turn, role, text), ordered by turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_turns(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n).select("conv_id", "turn", "role")


def token_buffer(turns: DataFrame, most: int, buffer: int) -> DataFrame:
    """Turns that stay: all within `most` estimated tokens (bytes / 4), else the newest within most - buffer."""
    all_ = Window.partitionBy("conv_id")
    newest = all_.orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = turns.withColumn("tokens", F.floor(F.octet_length("text") / 4)).withColumn("total", F.sum("tokens").over(all_)).withColumn("kept", F.sum("tokens").over(newest))
    return x.where((F.col("total") <= most) | (F.col("kept") <= most - buffer)).select("conv_id", "turn", F.col("tokens").cast("long").alias("tokens"))


def summaries(turns: DataFrame, keep: int) -> DataFrame:
    """One row for all but the last `keep` turns of a conversation: how many, tokens, first and last turn."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    old = turns.withColumn("back", F.row_number().over(w)).where(F.col("back") > keep)
    return old.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.octet_length("text") / 4)).cast("long").alias("tokens"), F.min("turn").alias("first"), F.max("turn").alias("last"))


def overflowing(turns: DataFrame, most_messages: int, most_tokens: int) -> DataFrame:
    """Conversations that are due for a summary: more messages or estimated tokens than these."""
    x = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.floor(F.octet_length("text") / 4)).cast("long").alias("tokens"))
    return x.where((F.col("messages") > most_messages) | (F.col("tokens") > most_tokens))
