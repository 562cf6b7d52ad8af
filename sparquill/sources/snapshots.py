"""Stored entries in versions: each write is a snapshot that can be read again as it was.

A write puts its rows into a folder of its own and then names that folder in a
manifest. Only manifests make a version, so a write that fails leaves what was
there before; vacuum() drops what such writes left. Rows of a version replace
those of the same key; deletions are rows, too. compact() writes all live rows
as one, from which later reads start. Entries lie in folders by the columns of
`by`, and a filter on these reads their folders alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version int, folder string, whole boolean, rows long, written timestamp"


@dataclass(frozen=True)
class Snapshots:
    """Versions at a path; `key` names an entry and holds the columns of `by`, which are not null."""

    spark: SparkSession
    path: str
    key: Sequence[str]
    by: Sequence[str] = ()

    def manifests(self) -> DataFrame:
        """(version, folder, whole, rows, written) of all versions."""
        try:
            return self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.path}/manifests")
        except AnalysisException as wrong:
            if "PATH_NOT_FOUND" not in str(wrong):
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def last(self) -> int:
        """The last version; 0 before the first."""
        return self.manifests().agg(F.max("version")).first()[0] or 0

    def _write(self, rows: DataFrame, whole: bool) -> int:
        folder, version = f"data/{uuid.uuid4().hex}", self.last() + 1
        rows.write.partitionBy(*self.by).parquet(f"{self.path}/{folder}")
        n = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{folder}").count()
        entry = self.spark.range(1).select(F.lit(version).alias("version"), F.lit(folder).alias("folder"), F.lit(whole).alias("whole"), F.lit(n).cast("long").alias("rows"), F.current_timestamp().alias("written"))
        entry.coalesce(1).write.mode("error").parquet(f"{self.path}/manifests/{version:09d}")  # a second writer of this version fails here
        return version

    def put(self, rows: DataFrame) -> int:
        """A version in which these rows replace those of their keys. A key may come once."""
        return self._write(rows.withColumn("__gone", F.lit(False)), False)

    def delete(self, keys: DataFrame) -> int:
        """A version without the entries of these keys."""
        columns = self.read().dtypes
        gone = keys.select(*self.key).distinct()
        empty = [F.lit(None).cast(kind).alias(c) for c, kind in columns if c not in self.key]
        return self._write(gone.select(*self.key, *empty, F.lit(True).alias("__gone")), False)

    def compact(self) -> int:
        """A version of all live rows, from which reads of it and of later ones start."""
        return self._write(self.read().withColumn("__gone", F.lit(False)), True)

    def read(self, as_of: int | None = None) -> DataFrame:
        """The entries as of a version, the last without one."""
        last = self.last() if as_of is None else as_of
        past = self.manifests().where(F.col("version") <= last)
        whole = past.where("whole").agg(F.max("version")).first()[0] or 0
        used = past.where(F.col("version") >= whole).orderBy("version").collect()  # a row a write since the last compaction
        if not used or used[-1].version != last:
            raise ValueError(f"no version {last} at {self.path}")
        parts = [self.spark.read.parquet(f"{self.path}/{m.folder}").withColumn("__version", F.lit(m.version)) for m in used]
        if len(parts) == 1:
            return parts[0].where("not __gone").drop("__gone", "__version")
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part, allowMissingColumns=True)
        others = [c for c in rows.columns if c not in self.key and c != "__version"]
        newest = rows.groupBy(*self.key).agg(F.max_by(F.struct(*others), "__version").alias("__newest"))
        return newest.where("not __newest.__gone").select(*self.key, *(F.col(f"__newest.{c}").alias(c) for c in others if c != "__gone"))

    def changes(self, before: int, after: int) -> DataFrame:
        """key and change (added, changed, removed) of entries that differ between two versions."""
        old, new = self.read(before), self.read(after)
        sign = lambda df: df.select(*self.key, F.md5(F.to_json(F.struct(*sorted(c for c in df.columns if c not in self.key)))).alias("sign"))
        both = sign(old).withColumnRenamed("sign", "was").join(sign(new).withColumnRenamed("sign", "now"), list(self.key), "full")
        kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
        return both.select(*self.key, kind.alias("change")).where("change is not null")

    def vacuum(self) -> int:
        """Drops folders that no version names; run it while nothing writes. How many there were."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        data = jvm.Path(f"{self.path}/data")
        files = data.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not files.exists(data):
            return 0
        named = {m.folder.rsplit("/", 1)[-1] for m in self.manifests().select("folder").collect()}
        left = [x.getPath() for x in files.listStatus(data) if x.getPath().getName() not in named]
        for folder in left:
            files.delete(folder, True)
        return len(left)
