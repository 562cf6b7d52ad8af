"""Analytics over accesses to a cache: what to evict, what to admit, what is alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entries(events: DataFrame, as_of: str) -> DataFrame:
    """One row a key (user_id and event_type): accesses, mean size, seconds since the last access and the first."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    return events.groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("accesses"), F.avg("value").alias("size"), (age - F.unix_timestamp(F.max("ts"))).alias("idle"), (age - F.unix_timestamp(F.min("ts"))).alias("age"),
    )


def eviction_order(cache: DataFrame, policy: str, n: int) -> DataFrame:
    """The n entries that the policy would drop first: a bounded list.

    lru: longest idle; lfu: fewest accesses, then shortest idle; gdsf: least
    (log2 accesses + 1) / size / (age + 1).
    """
    key = {
        "lru": -F.col("idle").cast("double"), "lfu": F.col("accesses").cast("double"),
        "gdsf": (F.log2("accesses") + 1) / F.greatest("size", F.lit(1.0)) / (F.col("age") + 1) * 1e6,
    }[policy]
    second = F.col("idle") if policy == "lfu" else F.lit(0)
    return cache.select("user_id", "event_type", F.round(key, 6).alias("priority"), second.cast("long").alias("then")).orderBy("priority", "then", "user_id", "event_type").limit(n).select("user_id", "event_type", "priority")


def expired(cache: DataFrame, seconds: int) -> DataFrame:
    """Entries, expired ones and accesses by kind."""
    return cache.groupBy("event_type").agg(F.count(F.lit(1)).alias("entries"), F.sum((F.col("idle") > seconds).cast("long")).alias("expired"), F.sum("accesses").alias("accesses"))


def popular(events: DataFrame, n: int) -> DataFrame:
    """The n most frequent keys with their share: a bounded report."""
    g = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return g.join(F.broadcast(total)).select("user_id", "n", F.round(F.col("n") / F.col("total"), 6).alias("share")).orderBy(F.desc("n"), "user_id").limit(n)


def sessions(events: DataFrame, gap_minutes: int) -> DataFrame:
    """Sessions of users, parted by pauses longer than the gap."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pause = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))
    x = events.withColumn("new", F.coalesce((pause > gap_minutes * 60).cast("int"), F.lit(1))).withColumn("session", F.sum("new").over(w))
    return x.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def state_before(events: DataFrame, kind: str, before: str) -> DataFrame:
    """For each event of a kind the latest event of another kind that the user had before it, if any."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == before, F.col("event_id")), ignorenulls=True).over(w)
    return events.withColumn("previous", last).where(F.col("event_type") == kind).select("event_id", "previous")


def semantic_order(cache: DataFrame, n: int) -> DataFrame:
    """The n entries with the least (log2 accesses + 1) * cluster score / (idle + 1): a bounded list."""
    score = (F.log2("accesses") + 1) * F.coalesce("cluster", F.lit(1.0)) / (F.col("idle") + 1)
    return cache.select("user_id", "event_type", F.round(score * 1e6, 6).alias("score")).orderBy("score", "user_id", "event_type").limit(n)


def linear_order(cache: DataFrame, weights: tuple[float, float, float, float, float], ttl: int, n: int) -> DataFrame:
    """The n entries with the least weighted sum of 1 / (idle + 1), log2 accesses, 1 / (size + 1), age and time to live."""
    parts = (1 / (F.col("idle") + 1), F.log2("accesses"), 1 / (F.col("size") + 1), F.col("age"), ttl - F.col("age"))
    score = sum((p * w for p, w in zip(parts, weights, strict=True)), F.lit(0.0))
    return cache.select("user_id", "event_type", F.round(score, 6).alias("score")).orderBy("score", "user_id", "event_type").limit(n)


def admitted(cache: DataFrame, against: DataFrame) -> DataFrame:
    """Of candidates (key, victim) those whose frequency exceeds the victim's; cache: key, frequency."""
    own = cache.select("key", "frequency")
    x = against.join(own, "key", "left").join(own.toDF("victim", "victims"), "victim", "left")
    return x.select("key", "victim", (F.coalesce("frequency", F.lit(0)) > F.coalesce("victims", F.lit(0))).alias("admit"))


def insights(events: DataFrame, hit: str) -> DataFrame:
    """Requests, hits, hit share, mean value and users of a cache by kind; hit: a condition."""
    h = F.expr(hit)
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("requests"), F.sum(h.cast("long")).alias("hits"), F.round(F.avg(h.cast("double")), 6).alias("hit_share"), F.round(F.avg("value"), 6).alias("mean_value"), F.countDistinct("user_id").alias("users"))


def repeated_texts(docs: DataFrame) -> DataFrame:
    """Rows, different texts, and what keeping one of each saves."""
    x = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("size"))
    return x.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_texts"), F.sum((F.col("n") - 1) * F.col("size")).alias("saved_bytes"))


def compression(vectors: DataFrame) -> DataFrame:
    """Bytes of all vectors plain and as one byte a place with scale and offset, and their ratio."""
    n = F.size("embedding").cast("long")
    x = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum(4 * n).alias("plain"), F.sum(n + 8).alias("packed"))
    return x.select("n", "plain", "packed", F.round(F.col("plain") / F.col("packed"), 6).alias("ratio"))


def _cells(key: Column, depth: int, width: int) -> Column:
    """A cell in each row of the sketch, from the first 32 bits of a seeded hash."""
    seeded = lambda i: F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{i}"))), 1, 8), 16, 10).cast("long") % width
    return F.array(*(F.struct(F.lit(i).alias("row"), seeded(i).alias("cell")) for i in range(depth)))


def frequency_sketch(rows: DataFrame, key: str, depth: int = 4, width: int = 256) -> DataFrame:
    """(row, cell, n): the count-min sketch of a column's values, depth * width rows at most; null counts as no value."""
    x = rows.where(F.col(key).isNotNull()).select(F.inline(_cells(F.col(key).cast("string"), depth, width)))
    return x.groupBy("row", "cell").agg(F.count(F.lit(1)).alias("n"))


def estimates(keys: DataFrame, key: str, sketch: DataFrame, depth: int = 4, width: int = 256) -> DataFrame:
    """(key, estimate): the least of a key's cells, 0 if one is empty; never below its count."""
    x = keys.select(key, F.inline(_cells(F.col(key).cast("string"), depth, width)))
    x = x.join(F.broadcast(sketch), ["row", "cell"], "left")  # depth * width rows at most
    return x.groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
