"""Connected components of links between documents, by star contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node that has a link; root: the least node it can reach, left out for the roots.

    links: (a, b), in any order and repeated. Each round hangs every node under
    the least node near it, first seen from all its neighbours, then from the
    smaller ones, until only stars are left; nothing is gathered by node but
    minima, so that one hub may hold any share of the links.
    """
    edges = scratch.table(links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct(), f"{name}0")
    state, turn = None, 0
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges
        state, turn = now, turn + 1
        both = edges.union(edges.select("root", "node")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", "e.m").where("u > m")
        edges = scratch.table(small.distinct().toDF("node", "root"), f"{name}{turn}")
        scratch.drop(f"{name}{turn - 1}")
