"""What iterative plans share: rounds that end their lineage, and broadcasts of checked size."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; in local mode without one, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="sparquill-"))
    return _own_folder[0]


def settled(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in the folder that spark.checkpoint.dir names; in local mode without one, a folder of our own."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sparquill-"))
    return df.checkpoint()


def few_rows(df: DataFrame, most: int) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
