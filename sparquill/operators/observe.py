"""Analytics over operational events: event_id, ts, user_id, event_type, value, props."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rounds import settled


FEW_VALUES = 1_000_000  # different values of a group that one task may sort
FEW_GROUPS = 100_000  # groups, a row of places each, that may be broadcast


def at_places(events: DataFrame, places: dict[str, Column], by: str = "event_type", value: str = "value", few: int = FEW_VALUES, parts: int = 200) -> DataFrame:
    """(by, one column for each name): the values at these places (from 0, of `n` sorted ones), null where there is none.

    Values are counted first, so that repeats move as one row. A group of more
    than `few` different values is cut into parts at approximate quantiles, the
    numbers of rows a part say which parts hold the places, and only those are
    sorted, each by itself: exact either way, and no task sorts a large group.
    """
    counts = events.groupBy(by, F.col(value).alias("v")).agg(F.count(value).alias("c"))
    most, groups = counts.groupBy(by).agg(F.count(F.lit(1)).alias("d")).agg(F.max("d"), F.count(F.lit(1))).first()
    hint = F.broadcast if groups <= FEW_GROUPS else (lambda d: d)
    if (most or 0) <= few:
        w = Window.partitionBy(by)
        x = counts.select(by, "v", "c", F.sum("c").over(w.orderBy("v")).alias("last"), F.sum("c").over(w).alias("n"))
        here = lambda p: (p >= F.col("last") - F.col("c")) & (p < F.col("last"))
        return hint(x.groupBy(by).agg(*(F.max(F.when(here(p), F.col("v"))).alias(k) for k, p in places.items())))
    same = lambda d: d.withColumnRenamed(by, "g")
    cuts = settled(counts.groupBy(by).agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 10_000).alias("cuts"), F.sum("c").alias("n")))
    x = counts.join(hint(same(cuts)), F.col(by).eqNullSafe(F.col("g"))).withColumn("part", F.size(F.filter("cuts", lambda e: e < F.col("v")))).select(by, "v", "c", "n", "part")
    sizes = x.groupBy(by, "part").agg(F.sum("c").alias("size"), F.max("n").alias("n"))
    ahead = F.sum("size").over(Window.partitionBy(by).orderBy("part")) - F.col("size")  # `parts` rows a group at most
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), p.cast("long").alias("place")) for k, p in places.items())))
    at = sizes.withColumn("ahead", ahead).select(by, "part", "size", "ahead", wanted.alias("w")).where("w.place >= ahead and w.place < ahead + size")
    holds = at.groupBy(by, "part").agg(F.max("ahead").alias("ahead"), F.collect_list("w").alias("w"))  # as many as there are places
    hit = x.join(hint(same(holds).withColumnRenamed("part", "p")), F.col(by).eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    last = F.col("ahead") + F.sum("c").over(Window.partitionBy(by, "part").orderBy("v"))
    hit = hit.withColumn("last", last).select(by, "v", F.explode(F.filter("w", lambda w: (w["place"] >= F.col("last") - F.col("c")) & (w["place"] < F.col("last")))).alias("w"))
    found = hit.groupBy(by).agg(*(F.max(F.when(F.col("w.name") == k, F.col("v"))).alias(k) for k in places))
    return hint(settled(cuts.select(F.col(by).alias("g")).join(found, F.col("g").eqNullSafe(F.col(by)), "left").select(F.col("g").alias(by), *places)))


def _discrete(share: float) -> Column:
    """Place of the first of n sorted values by which this share of them is reached."""
    return F.greatest(F.ceil(F.lit(share) * F.col("n")) - 1, F.lit(0))


def _with(left: DataFrame, right: DataFrame, by: str = "event_type") -> DataFrame:
    """left and right side by side, a null group meeting its like."""
    return left.join(right.withColumnRenamed(by, "g"), F.col(by).eqNullSafe(F.col("g"))).drop("g")


def histogram(events: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """Cumulative buckets by event type: how many values are at most each bound, all of them, and their sum."""
    le = [F.sum((F.col("value") <= b).cast("int")).alias(f"le_{b:g}") for b in bounds]
    return events.groupBy("event_type").agg(*le, F.count("value").alias("le_inf"), F.round(F.sum("value"), 4).alias("total"))


def profile(events: DataFrame) -> DataFrame:
    """count, mean, population deviation, least, greatest and exact percentiles by event type."""
    sums = events.groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("sd"), F.min("value").alias("low"), F.max("value").alias("high"))
    return _with(sums, at_places(events, {"p50": _discrete(0.5), "p95": _discrete(0.95), "p99": _discrete(0.99)}))


def bottlenecks(events: DataFrame, threshold: float) -> DataFrame:
    """Types whose mean exceeds the threshold, with impact mean/1000 * log10(n) * max/mean and distinct users."""
    g = events.groupBy("event_type").agg(F.avg("value").alias("mean"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    impact = F.col("mean") / 1000 * F.log10("n") * F.col("high") / F.col("mean")
    return g.where(F.col("mean") > threshold).select("event_type", F.round("mean", 6).alias("mean"), "n", "users", F.round(impact, 6).alias("impact"))


def user_activity(events: DataFrame, since: str, until: str) -> DataFrame:
    """Actions, distinct users, kinds and mean value between two instants."""
    x = events.where((F.col("ts") >= F.lit(since).cast("timestamp")) & (F.col("ts") < F.lit(until).cast("timestamp")))
    return x.groupBy("event_type").agg(F.count(F.lit(1)).alias("actions"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean_value"))


def daily_trend(events: DataFrame) -> DataFrame:
    """Events and sums of each day with the change to the day before."""
    day = events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    before = F.lag("n").over(Window.orderBy("day"))  # a row a day
    return day.select(F.col("day").cast("string").alias("day"), "n", "total", F.round(F.when(before > 0, (F.col("n") - before) * 100.0 / before), 6).alias("growth"))


def outliers(events: DataFrame) -> DataFrame:
    """Events beyond 1.5 interquartile ranges of their type's quartiles, taken from exact discrete percentiles."""
    x = _with(events, at_places(events, {"q1": _discrete(0.25), "q3": _discrete(0.75)}))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return x.where((F.col("value") < F.col("q1") - reach) | (F.col("value") > F.col("q3") + reach)).select("event_id", "event_type", "value")


def rate_alerts(events: DataFrame, minutes: int, share: float) -> DataFrame:
    """Windows in which errors are more than a share of all events."""
    x = events.groupBy(F.window("ts", f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("event_type") == "error").cast("int")).alias("errors"))
    return x.where(F.col("errors") > share * F.col("n")).select(F.col("w.start").cast("string").alias("start"), "n", "errors")


def retention(events: DataFrame, as_of: str, archive_days: int, delete_days: int) -> DataFrame:
    """How many events of each type are kept, archived or deleted by age on a given day."""
    age = F.datediff(F.lit(as_of).cast("timestamp"), F.col("ts"))
    action = F.when(age > delete_days, "delete").when(age > archive_days, "archive").otherwise("keep")
    return events.groupBy("event_type", action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


def search_events(events: DataFrame, kind: str, at_least: float, key: str, key_at_least: int, offset: int, limit: int) -> DataFrame:
    """Events of a kind with a value and a property at least so large, newest first: a page of a sorted list."""
    found = events.where((F.col("event_type") == kind) & (F.col("value") >= at_least) & (F.get_json_object("props", f"$.{key}").cast("long") >= key_at_least))
    return found.orderBy(F.desc("ts"), "event_id").offset(offset).limit(limit).select("event_id", "user_id", "value")


def summary(events: DataFrame) -> DataFrame:
    """count, mean, median, population deviation and the 95 % interval of the mean by event type."""
    half = 1.96 * F.stddev_pop("value") / F.sqrt(F.count("value"))
    sums = events.groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg("value") - half, 6).alias("low"), F.round(F.avg("value") + half, 6).alias("high"))
    middle = at_places(events, {"m1": F.floor((F.col("n") - 1) / 2), "m2": F.floor(F.col("n") / 2)})
    return _with(sums, middle).select("event_type", "n", "mean", F.round((F.col("m1") + F.col("m2")) / 2, 6).alias("median"), "low", "high")


def forecast(events: DataFrame, days: int) -> DataFrame:
    """A least-squares line through the daily counts of each type, its strength, and the next days on it."""
    day = events.groupBy("event_type", F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).alias("x")).agg(F.count(F.lit(1)).alias("y"))
    line = day.groupBy("event_type").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("base"), F.regr_r2("y", "x").alias("r2"), F.max("x").alias("last"))
    ahead = line.select("event_type", "slope", "base", "r2", "last", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("step"))
    return ahead.select("event_type", "step", F.round(F.col("base") + F.col("slope") * (F.col("last") + F.col("step")), 6).alias("expected"), F.round("r2", 6).alias("strength"))


def anomalies(events: DataFrame, reach: float) -> DataFrame:
    """The latest event of each user and whether it lies beyond so many deviations of all of the user's, ten at least."""
    latest = F.max_by("value", F.struct("ts", "event_id"))
    g = events.groupBy("user_id").agg(latest.alias("last"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("value").alias("n"))
    far = (F.col("n") >= 10) & (F.col("sd") > 0) & (F.abs(F.col("last") - F.col("mean")) > reach * F.col("sd"))
    return g.select("user_id", F.round("last", 6).alias("last"), far.alias("anomaly"))


def trailing(events: DataFrame, minutes: int, spans: int = 8) -> DataFrame:
    """Each event's trailing window by type: least, first and last value, mean, deviation, events and whole minutes.

    A type's time is cut into blocks as long as a window, so that a window is the
    end of one block and the beginning of the next. Both only ever grow, the one
    backwards and the other forwards, so each event is added to each once,
    however many others are in its window. The halves' deviations are merged by
    their means. A task gets a stretch of `spans` blocks, and copies of the
    events of the block ahead of it, which have no row of their own.
    """
    reach = 60 * minutes
    length = max(reach, 0) + 1  # seconds from the oldest to the newest in reach, both counted
    block, after = F.floor(F.col("at") / length), F.floor(F.col("at") / length) + 1
    of = lambda b: F.floor(b / spans)
    x = events.select("event_id", "event_type", "value", F.unix_timestamp("ts").alias("at"))
    next_one = F.when(of(after) > of(block), F.struct(of(after).alias("stretch"), F.lit(False).alias("mine")))
    x = x.select("event_id", "event_type", "value", "at", F.inline(F.array_compact(F.array(F.struct(of(block).alias("stretch"), F.lit(True).alias("mine")), next_one))))
    x = x.repartition("event_type", "stretch")
    # seen from the block after, an event is in reach of all up to `reach` behind it
    own = F.when(F.col("mine"), F.struct(block.alias("block"), F.col("at").alias("key"), F.lit(True).alias("own")))
    old = F.when(of(after) == F.col("stretch"), F.struct(after.alias("block"), (F.col("at") + reach).alias("key"), F.lit(False).alias("own")))
    x = x.select("event_id", "event_type", "value", "at", "stretch", F.inline(F.array_compact(F.array(own, old))))
    w = Window.partitionBy("event_type", "stretch", "block")
    up_to = lambda order: w.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.struct(F.col("at").alias("t"), F.col("event_id").alias("i"), F.col("value").alias("v"))
    halves = {"1": (up_to(F.asc("key")), F.col("own")), "2": (up_to(F.desc("key")), ~F.col("own"))}
    seen = []
    for k, (frame, part) in halves.items():
        v = F.when(part, F.col("value"))
        each = {"low": F.min(v), "high": F.max(v), "a": F.min(F.when(part, place)), "b": F.max(F.when(part, place)), "mean": F.avg(v), "var": F.var_pop(v), "c": F.count(v), "n": F.count(F.when(part, F.lit(1)))}
        seen += [f.over(frame).alias(name + k) for name, f in each.items()]
    x = x.select("event_id", "event_type", "own", *seen).where("own")
    both = lambda f, name: f(F.col(f"{name}1"), F.col(f"{name}2"))
    c1, c2, m1, m2, v1, v2 = (F.coalesce(F.col(k), F.lit(0)) for k in ("c1", "c2", "mean1", "mean2", "var1", "var2"))
    mean = F.when(c2 == 0, F.col("mean1")).when(c1 == 0, F.col("mean2")).otherwise((c1 * m1 + c2 * m2) / (c1 + c2))
    spread = F.try_divide(c1 * v1 + c2 * v2 + F.coalesce(F.try_divide(c1 * c2 * (m1 - m2) * (m1 - m2), c1 + c2), F.lit(0.0)), c1 + c2)
    alike = both(F.least, "low") == both(F.greatest, "high")  # equal values have no deviation, whatever their means round to
    return x.select(
        "event_id", "event_type", both(F.least, "low").alias("least"), both(F.least, "a").alias("a"), both(F.greatest, "b").alias("b"), mean.alias("mean"),
        F.when(alike, 0.0).otherwise(F.sqrt(spread)).alias("sd"), (F.col("n1") + F.col("n2")).alias("n"),
    )


def alerts(events: DataFrame, minutes: int, threshold: float, rate: float, reach: float) -> DataFrame:
    """Alerts at each event over its trailing window: all values over the threshold; a change a minute over the rate; the last value beyond so many deviations; and whether all or any of these hold."""
    x = trailing(events, minutes)
    whole = F.floor((F.col("b.t") - F.col("a.t")) / 60)
    steep = F.coalesce((F.col("n") >= 2) & (whole > 0) & (F.try_divide(F.col("b.v") - F.col("a.v"), whole.cast("double")) > rate), F.lit(False))
    odd = F.coalesce((F.col("n") >= 5) & (F.col("sd") > 0) & (F.abs(F.try_divide(F.col("b.v") - F.col("mean"), F.col("sd"))) > reach), F.lit(False))
    x = x.select("event_id", "event_type", (F.col("least") > threshold).alias("high"), steep.alias("steep"), odd.alias("odd"))
    return x.select("event_id", "event_type", "high", "steep", "odd", (F.col("high") & F.col("steep") & F.col("odd")).alias("all_of"), (F.col("high") | F.col("steep") | F.col("odd")).alias("any_of"))


def latest_values(events: DataFrame) -> DataFrame:
    """Gauges: the last value of each type."""
    return events.groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def ranked_percentiles(events: DataFrame, shares: tuple[float, ...], rule: str) -> DataFrame:
    """Values at nearest ranks by type, never interpolated, 0 where there is no such place.

    rule: "round" for round(p (n-1)), "floor" for floor(n p), "clipped" for the least of floor(n p) and n - 1.
    """
    n = F.col("n")
    at = {"round": lambda p: F.round(p * (n - 1)), "floor": lambda p: F.floor(n * p), "clipped": lambda p: F.least(F.floor(n * p), n - 1)}[rule]
    x = at_places(events, {f"p{round(100 * p)}": at(p) for p in shares})
    return x.select("event_type", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in x.columns if c != "event_type"))


def operations(events: DataFrame) -> DataFrame:
    """Count, mean, extremes, deviation, and operations a second between first and last, by type."""
    g = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.stddev_pop("value").alias("sd"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"))
    has = lambda *parts: F.lower("event_type").rlike("|".join(parts))
    kind = F.when(has("database", "db"), "database").when(has("cache"), "cache").when(has("network", "http"), "network").when(has("io", "file"), "io").when(F.col("mean") > 1000, "algorithm").when(F.col("mean") > 500, "cpu").otherwise("memory")
    return g.select("event_type", "n", F.round("mean", 6).alias("mean"), "low", "high", F.round("sd", 6).alias("sd"), F.round(F.col("n") / F.greatest("seconds", F.lit(1)), 6).alias("rate"), kind.alias("bottleneck"))


def direction(events: DataFrame) -> DataFrame:
    """Where each type's daily sums go: stable under half their deviation, else by the sign of last less first."""
    day = events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("y"))
    g = day.groupBy("event_type").agg(F.min_by("y", "day").alias("first"), F.max_by("y", "day").alias("last"), F.stddev_pop("y").alias("sd"), F.count(F.lit(1)).alias("n"))
    change = F.col("last") - F.col("first")
    name = F.when((F.col("n") < 2) | (F.abs(change) < 0.5 * F.col("sd")), "stable").when(F.col("sd") > 2 * F.abs(change), "volatile").when(change > 0, "increasing").otherwise("decreasing")
    return g.select("event_type", F.round("sd", 4).alias("volatility"), F.round(change, 4).alias("change"), name.alias("direction"))


def daily_by(events: DataFrame, column: str, start: str, days: int) -> DataFrame:
    """Counts of each value of a column for every day of a calendar, also where there are none."""
    days_ = events.sparkSession.range(days).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("day"))
    kinds = events.select(column).distinct()
    counts = events.groupBy(column, F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    every = kinds.join(F.broadcast(days_))  # a calendar of `days` rows
    return every.join(counts, [column, "day"], "left").select(column, F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def log_stats(events: DataFrame, as_of: str) -> DataFrame:
    """Rows, errors, errors of the last day, oldest and newest of all events."""
    err = F.col("event_type") == "error"
    return events.agg(F.count(F.lit(1)).alias("n"), F.sum(err.cast("long")).alias("errors"), F.sum((err & (F.col("ts") >= F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 1 DAY"))).cast("long")).alias("recent_errors"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm").alias("oldest"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm").alias("newest"))


def metric_lines(events: DataFrame, since: str, until: str, kinds: list[str]) -> DataFrame:
    """Lines of name, type, value and labels for a metrics file, between two instants and of some types."""
    x = events.where((F.col("ts") >= F.lit(since).cast("timestamp")) & (F.col("ts") <= F.lit(until).cast("timestamp")) & F.col("event_type").isin(*kinds))
    g = x.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.concat(F.lit("events,counter,"), F.col("n").cast("string"), F.lit(',"type='), "event_type", F.lit(";user="), F.col("user_id").cast("string"), F.lit('"')).alias("line"))


def long_form(summary: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, metric, value) rows of a wide table."""
    return summary.unpivot([key], columns, "metric", "value")
