"""What the operators of this subpackage share: tables between phases, and sizes."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of our own only where it names none, and only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="sparquill-"))
    return _own_folder[0]


class Scratch:
    """Written tables of one run of an operator, in the shared folder; what is left of them goes when the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/sparquill/{uuid.uuid4().hex}"
        files, path = self._files(self.root)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back: lineage ends here, and any executor can read it."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Deletes a table that nothing will read again."""
        files, path = self._files(self.path(name))
        files.delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size; where it knows nothing, the bytes of the texts."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 55 else df.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def pieces_for(df: DataFrame, piece_bytes: int, least: int = 8, most: int = 1 << 20) -> int:
    """In how many pieces of about piece_bytes df would be dealt."""
    return max(least, min(most, math.ceil(estimated_bytes(df) / piece_bytes)))


def join_sizes(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner", many: int = 500, few: int = 1_000_000) -> DataFrame:
    """rows joined to groups (one row a group, with its size) on keys, so that no task gets a large group whole.

    Groups of more than `many` rows, a share of 1 / many of all rows at most,
    are broadcast if there are no more than `few`; the others are joined by a
    shuffle.
    """
    hot = groups.where(F.col(size) > many)
    if not 0 < hot.count() <= few:
        return rows.join(groups, keys, how)
    beside = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(beside.join(groups.where(F.col(size) <= many), keys, how))


def keyed(df: DataFrame, *columns: str) -> DataFrame:
    """These columns of the rows that have a doc_id."""
    return df.select("doc_id", *columns).where(F.col("doc_id").isNotNull())
