"""Alerts with a life: raised while a metric meets a rule, silent in their cooldown, acknowledged, resolved; as a batch and as a stream.

Metrics are sampled at ticks, the ends of windows of a fixed length: a metric's
value at a tick is the mean of its events in that window. Spark makes the ticks
with partial aggregates, so what reaches a rule's task grows with time, not with
the number of events, and no hot metric is sent anywhere whole.

At each tick of its metric a rule is evaluated over the ticks of its last
`minutes`, that tick included:
  threshold  every value compares to the bound as the rule says;
  rate       (last - first value) a whole minute does; never with fewer than two ticks or under a minute;
  anomaly    the last value is more than `bound` population deviations from the mean; never before the
             metric's tenth tick, with fewer than five in reach, or without deviation.
A metric without ticks for that long has none to meet the rule: at the first
tick with none in reach the rule does not hold.

A rule that holds raises an alert ("triggered") if none is open, or if the open
one was raised `cooldown` minutes ago or more, which then takes its place. A rule
that does not hold ends an open alert: "resolved", or "closed" if it had been
acknowledged or the rule does not resolve by itself. An acknowledgement of an
open alert says "acknowledged"; others change nothing. At one instant the tick
comes first, then the acknowledgement.

Rows without an instant or a metric, and values that are null, are left out; a
rule that is not enabled says nothing; no events give no rows. Late rows of a
stream are dropped by its watermark, and Spark counts them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

MINUTE = 60_000_000  # microseconds
NEAR = 2.220446049250313e-16  # values closer than this are equal
COMPARE = {
    "gt": lambda v, b: v > b,
    "lt": lambda v, b: v < b,
    "ge": lambda v, b: v >= b,
    "le": lambda v, b: v <= b,
    "eq": lambda v, b: abs(v - b) < NEAR,
    "ne": lambda v, b: abs(v - b) >= NEAR,
}
LOG = "rule_id string, at_us long, status string, value double"


@dataclass(frozen=True)
class Rule:
    """What is watched, when it holds, and how its alerts behave."""

    rule_id: str
    metric: str
    kind: str  # threshold, rate or anomaly
    operator: str  # of COMPARE; an anomaly has none
    bound: float
    minutes: int
    cooldown: int = 5
    severity: str = "medium"
    resolves: bool = True
    enabled: bool = True

    def holds(self, ticks: np.ndarray, values: np.ndarray, seen: int) -> bool:
        """Whether the rule holds at the last of these ticks, all within reach; `seen` counts the metric's ticks so far."""
        if self.kind == "threshold":
            return all(COMPARE[self.operator](v, self.bound) for v in values)
        if self.kind == "rate":
            whole = (ticks[-1] - ticks[0]) // MINUTE
            return bool(whole > 0 and COMPARE[self.operator]((values[-1] - values[0]) / whole, self.bound))
        sd = values.std()
        return bool(seen >= 10 and len(values) >= 5 and sd > 0 and abs(values[-1] - values.mean()) / sd > self.bound)


def checked(rules: Sequence[Rule], every: int) -> list[Rule]:
    """The enabled rules, if they can be evaluated at ticks of `every` minutes."""
    if len({r.rule_id for r in rules}) < len(rules):
        raise ValueError("rules share an id")
    for r in rules:
        if r.kind not in ("threshold", "rate", "anomaly") or (r.kind != "anomaly" and r.operator not in COMPARE):
            raise ValueError(f"unknown kind or operator: {r}")
        if r.minutes % every or r.minutes < 0:
            raise ValueError(f"a rule's minutes must be a multiple of the {every} between ticks: {r}")
    return [r for r in rules if r.enabled]


@dataclass
class Life:
    """The state of one rule: the ticks in reach, how many there were, and the open alert."""

    rule: Rule
    every: int  # microseconds between ticks
    ticks: list[int] = field(default_factory=list)
    values: list[float] = field(default_factory=list)
    seen: int = 0
    raised: int | None = None
    known: bool = False  # acknowledged

    def silent_at(self) -> int | None:
        """The first tick with none in reach, if an alert waits for it."""
        return None if self.raised is None or not self.ticks else self.ticks[-1] + self.rule.minutes * MINUTE + self.every

    def _ended(self, at: int, value: float | None) -> tuple:
        status = "resolved" if self.rule.resolves and not self.known else "closed"
        self.raised, self.known = None, False
        return self.rule.rule_id, at, status, value

    def until(self, at: int) -> Iterator[tuple]:
        """What happens up to an instant, itself included, if no tick comes."""
        silent = self.silent_at()
        if silent is not None and silent <= at:
            yield self._ended(silent, None)

    def tick(self, at: int, value: float) -> Iterator[tuple]:
        yield from self.until(at - 1)
        self.seen += 1
        keep = next((i for i, t in enumerate(self.ticks) if t >= at - self.rule.minutes * MINUTE), len(self.ticks))
        self.ticks, self.values = [*self.ticks[keep:], at], [*self.values[keep:], value]
        if not self.rule.holds(np.array(self.ticks), np.array(self.values), self.seen):
            if self.raised is not None:
                yield self._ended(at, value)
        elif self.raised is None or self.raised + self.rule.cooldown * MINUTE <= at:
            self.raised, self.known = at, False
            yield self.rule.rule_id, at, "triggered", value

    def acknowledge(self, at: int) -> Iterator[tuple]:
        yield from self.until(at)
        if self.raised is not None and not self.known:
            self.known = True
            yield self.rule.rule_id, at, "acknowledged", None

    def over(self, rows: pd.DataFrame) -> Iterator[tuple]:
        """What the rows of a rule say: window ends with a value, instants of acknowledgements within these windows."""
        said = rows["ack_us"].notna()
        when = rows["ack_us"].where(said, rows["at_us"]).astype("int64")
        for at, ack, value in sorted(zip(when.tolist(), said.tolist(), rows["value"].tolist(), strict=True)):
            yield from self.acknowledge(at) if ack else self.tick(at, value)

    def dump(self) -> str:
        return json.dumps([self.ticks, self.values, self.seen, self.raised, self.known])

    def load(self, text: str) -> Life:
        self.ticks, self.values, self.seen, self.raised, self.known = json.loads(text)
        return self


def _sampled(rows: DataFrame, rules: Sequence[Rule], every: int) -> DataFrame:
    """(rule_id, ended, at_us, value, ack_us): of each window and rule the metric's mean and the first acknowledgement.

    rows: (ts, metric, value, rule_id), an event without a rule_id, an
    acknowledgement with nothing else. Later acknowledgements of one window
    change nothing, so the first stands for all. Rules are a literal list.
    """
    means = rows.where(F.col("ts").isNotNull() & (F.col("rule_id").isNotNull() | (F.col("metric").isNotNull() & F.col("value").isNotNull())))
    windows = means.groupBy(F.window("ts", f"{every} minutes").alias("w"), "metric", "rule_id").agg(
        F.avg("value").alias("value"), F.min(F.when(F.col("rule_id").isNotNull(), F.unix_micros("ts"))).alias("ack_us")
    )
    known = F.array(*(F.struct(F.lit(r.rule_id).alias("id"), F.lit(r.metric).alias("metric")) for r in rules))
    meant: Column = F.filter(known, lambda r: F.when(F.col("rule_id").isNull(), r["metric"] == F.col("metric")).otherwise(r["id"] == F.col("rule_id")))
    return windows.select(F.explode(meant).alias("r"), F.window_time("w").alias("ended"), F.unix_micros(F.col("w.end")).alias("at_us"), "value", "ack_us").select(
        F.col("r.id").alias("rule_id"), "ended", "at_us", "value", "ack_us"
    )


def _rows(events: DataFrame, acks: DataFrame | None) -> DataFrame:
    """Events (ts, event_type, value) and acknowledgements (rule_id, ts) in one shape."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("metric"), F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("rule_id"))
    if acks is None:
        return rows
    said = acks.where("rule_id is not null").select(F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"), "rule_id")
    return rows.unionByName(said)


def _named(log: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule_id, metric, severity, status, at, value) of a log."""
    names = F.create_map(*(F.lit(x) for r in rules for x in (r.rule_id, r.metric)))
    weights = F.create_map(*(F.lit(x) for r in rules for x in (r.rule_id, r.severity)))
    return log.select("rule_id", names[F.col("rule_id")].alias("metric"), weights[F.col("rule_id")].alias("severity"), "status", F.timestamp_micros("at_us").alias("at"), F.round("value", 6).alias("value"))


def alert_log(events: DataFrame, rules: Sequence[Rule], every: int, acks: DataFrame | None = None, until_us: int | None = None) -> DataFrame:
    """What happened to every rule's alerts, from all events at once.

    Evaluation ends at until_us (microseconds since 1970), windows that end
    later left out; without it at the end of the last window. A rule's ticks,
    one row each, are folded in order by one task.
    """
    live = checked(rules, every)
    if not live:
        return _named(events.sparkSession.createDataFrame([], LOG), list(rules) or [Rule("", "", "threshold", "gt", 0.0, 0)])
    by_id, step = {r.rule_id: r for r in live}, every * MINUTE
    rows = _rows(events, acks)
    if until_us is None:
        until_us = rows.agg(F.max(F.unix_micros(F.window("ts", f"{every} minutes")["end"]))).first()[0] or 0

    def fold(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        life = Life(by_id[key[0]], step)
        said = [*life.over(part), *life.until(until_us)]
        return pd.DataFrame(said, columns=["rule_id", "at_us", "status", "value"]).astype({"value": "float64"})

    sampled = _sampled(rows, live, every).where(F.col("at_us") <= until_us)
    return _named(sampled.select("rule_id", "at_us", "value", "ack_us").groupBy("rule_id").applyInPandas(fold, LOG), live)


class _Watch(StatefulProcessor):
    """Keeps a rule's Life between triggers; a timer ends the alert of a metric that fell silent."""

    def __init__(self, rules: list[Rule], step: int):
        self.rules, self.step = {r.rule_id: r for r in rules}, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("life", StructType([StructField("life", StringType())]))

    def _life(self, key: tuple) -> Life:
        life = Life(self.rules[key[0]], self.step)
        return life.load(self.state.get()[0]) if self.state.exists() else life

    def _kept(self, life: Life, said: list[tuple]) -> Iterator[pd.DataFrame]:
        self.state.update((life.dump(),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        silent = life.silent_at()
        if silent is not None:
            self.handle.registerTimer(-(-silent // 1000))
        if said:
            yield pd.DataFrame(said, columns=["rule_id", "at_us", "status", "value"]).astype({"value": "float64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        life = self._life(key)
        said = list(life.over(pd.concat(list(rows))))
        said += life.until(timerValues.getCurrentWatermarkInMs() * 1000)
        yield from self._kept(life, said)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        life = self._life(key)
        yield from self._kept(life, list(life.until(expiredTimerInfo.getExpiryTimeInMs() * 1000)))

    def close(self) -> None:
        pass


def alert_stream(events: DataFrame, rules: Sequence[Rule], every: int, late: str, acks: DataFrame | None = None) -> DataFrame:
    """alert_log() of streams, appended as the watermark (`late` behind the newest row) passes the ends of windows.

    Up to the watermark its rows are those of alert_log(), however rows were
    cut into triggers. The session must keep state in RocksDB
    (spark.sql.streaming.stateStore.providerClass).
    """
    live = checked(rules, every)
    if not live:
        raise ValueError("no rule is enabled")
    sampled = _sampled(_rows(events, acks).withWatermark("ts", late), live, every)
    log = sampled.groupBy("rule_id").transformWithStateInPandas(_Watch(live, every * MINUTE), LOG, "Append", "EventTime")
    return _named(log, live)


def open_alerts(log: DataFrame) -> DataFrame:
    """The alerts of a log that are open at its end: rule_id, metric, severity, status, since when, and when last changed.

    A log has one row for each change of a rule's alert. At one instant an end comes before a beginning, that before its acknowledgement.
    """
    place = F.when(F.col("status") == "triggered", 1).when(F.col("status") == "acknowledged", 2).otherwise(0)
    order = F.struct("at", place.alias("place"))
    last = log.groupBy("rule_id", "metric", "severity").agg(
        F.max_by("status", order).alias("status"), F.max(F.when(F.col("status") == "triggered", F.col("at"))).alias("since"), F.max("at").alias("changed")
    )
    return last.where(F.col("status").isin("triggered", "acknowledged"))


def alert_stats(log: DataFrame) -> DataFrame:
    """(severity, status, n): how many of the open alerts there are of each."""
    return open_alerts(log).groupBy("severity", "status").agg(F.count(F.lit(1)).alias("n"))
