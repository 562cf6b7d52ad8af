"""Alerts: rules at their edges, and the stream against the batch, trigger by trigger, over restarts. The SQL twins stand in test_catalog."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparquill.streaming.alerts import MINUTE, Life, Rule, alert_log, alert_stats, alert_stream, checked, open_alerts

START = dt.datetime(2024, 3, 1)
EVENTS, ACKS = "ts timestamp, event_type string, value double", "rule_id string, ts timestamp"
RULES = [
    Rule("high", "load", "threshold", "gt", 5.0, 20, 30, "critical"),
    Rule("rising", "load", "rate", "ge", 0.2, 30, 10, "high", resolves=False),
    Rule("odd", "load", "anomaly", "", 1.2, 120, 0, "low"),
    Rule("free", "disk", "threshold", "le", 4.0, 10, 20),
    Rule("off", "disk", "threshold", "gt", 0.0, 10, enabled=False),
]


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def life(rule, ticks, every=1):
    """(minute, status) of a rule over (minute, value) ticks."""
    state = Life(rule, every * MINUTE)
    return [(x[1] // MINUTE, x[2]) for t, v in ticks for x in state.tick(t * MINUTE, v)]


def rows(log):
    return sorted((r.at, r.rule_id, r.status, r.value) for r in log.collect())


def sample(seed, n=400):
    """Events in bursts with silences between, and acknowledgements, over two days."""
    rng = random.Random(seed)
    events = [(at(rng.choice((0, 300, 900, 1500)) + rng.uniform(0, 400)), rng.choice(("load", "load", "disk", "other")), rng.choice((None, *range(10)))) for _ in range(n)]
    acks = [(rng.choice(("high", "rising", "odd", "free", "off", "unknown", None)), at(rng.uniform(0, 2000))) for _ in range(n // 4)]
    return [(t, k, None if v is None else float(v)) for t, k, v in events], acks


def test_a_threshold_must_hold_for_the_whole_reach():
    rule = Rule("r", "m", "threshold", "gt", 80.0, 1, 0)
    assert life(rule, [(0, 50.0), (0, 75.0), (0, 85.0)]) == []  # three values at one instant, two of them under the bound
    assert life(rule, [(0, 50.0), (1, 85.0), (2, 90.0), (3, 10.0)]) == [(2, "triggered"), (3, "resolved")]


def test_a_rate_needs_whole_minutes():
    rule = Rule("r", "m", "rate", "gt", 10.0, 5, 0)
    assert life(rule, [(0, 50.0), (0, 85.0)]) == []
    assert life(rule, [(0, 50.0), (2, 75.0), (4, 76.0)]) == [(2, "triggered"), (4, "resolved")]


def test_an_anomaly_needs_ten_ticks_five_in_reach_and_deviation():
    rule = Rule("r", "m", "anomaly", "", 2.0, 60, 0)
    assert life(rule, [(t, 1.0) for t in range(8)] + [(8, 9.0)]) == []
    assert life(rule, [(t, 1.0) for t in range(9)] + [(9, 9.0)]) == [(9, "triggered")]
    assert life(rule, [(t, 1.0) for t in range(12)]) == []
    assert life(rule, [(t, 1.0) for t in range(9)] + [(100, 9.0)]) == []


@pytest.mark.parametrize(("operator", "fires"), [("gt", [6]), ("ge", [5, 6]), ("lt", [4]), ("le", [4, 5]), ("eq", [5]), ("ne", [4, 6])])
def test_operators(operator, fires):
    rule = Rule("r", "m", "threshold", operator, 5.0, 0, 0)
    assert [v for v in (4, 5, 6) if life(rule, [(0, float(v))])] == fires


def test_cooldown_silence_and_acknowledgement():
    state = Life(Rule("r", "m", "threshold", "gt", 0.0, 2, 3), MINUTE)
    said = [x for t in range(5) for x in state.tick(t * MINUTE, 1.0)]
    assert [(x[1] // MINUTE, x[2]) for x in said] == [(0, "triggered"), (3, "triggered")]
    said = [*state.acknowledge(5 * MINUTE), *state.acknowledge(5 * MINUTE), *state.until(6 * MINUTE), *state.until(7 * MINUTE), *state.acknowledge(8 * MINUTE)]
    assert [(x[1] // MINUTE, x[2]) for x in said] == [(5, "acknowledged"), (7, "closed")]


def test_rules_are_checked():
    with pytest.raises(ValueError, match="multiple"):
        checked([Rule("a", "m", "threshold", "gt", 1.0, 15)], 10)
    with pytest.raises(ValueError, match="share"):
        checked([RULES[0], RULES[0]], 10)
    with pytest.raises(ValueError, match="unknown"):
        checked([Rule("a", "m", "threshold", "above", 1.0, 10)], 10)


def test_empty_tables_nulls_and_no_rule(spark):
    none = spark.createDataFrame([], EVENTS)
    assert alert_log(none, RULES, 10, spark.createDataFrame([], ACKS)).count() == 0
    nulls = spark.createDataFrame([(None, "load", 9.0), (at(1), None, 9.0), (at(1), "load", None)], EVENTS)
    assert alert_log(nulls, RULES, 10, spark.createDataFrame([(None, at(1)), ("high", None)], ACKS)).count() == 0
    assert alert_log(nulls, [RULES[-1]], 10).columns == alert_log(nulls, RULES, 10).columns


@pytest.mark.parametrize("seed", [1, 2])
def test_log_is_that_of_ticks_counted_by_hand(spark, seed):
    events, acks = sample(seed)
    found = rows(alert_log(spark.createDataFrame(events, EVENTS), RULES, 10, spark.createDataFrame(acks, ACKS)))
    end = max([t for t, k, v in events] + [t for r, t in acks])
    end = at(10 * ((end - START) // dt.timedelta(minutes=10) + 1))
    want = []
    for rule in checked(RULES, 10):
        windows = {}
        for t, k, v in events:
            if k == rule.metric and v is not None:
                windows.setdefault((t - START) // dt.timedelta(minutes=10) + 1, []).append(v)
        said = sorted([(10 * w * MINUTE, 0, sum(v) / len(v)) for w, v in windows.items()] + [((t - START) // dt.timedelta(microseconds=1), 1, 0.0) for r, t in acks if r == rule.rule_id])
        state = Life(rule, 10 * MINUTE)
        log = [x for t, kind, v in said for x in (state.acknowledge(t) if kind else state.tick(t, v))]
        log += state.until((end - START) // dt.timedelta(microseconds=1))
        want += [(START + dt.timedelta(microseconds=t), r, s, None if v is None else round(v, 6)) for r, t, s, v in log]
    assert {s for _, _, s, _ in want} == {"triggered", "resolved", "closed", "acknowledged"}
    assert [x[:3] for x in found] == [x[:3] for x in sorted(want, key=lambda x: x[:3])]


def test_open_alerts_and_their_counts(spark):
    events = spark.createDataFrame([(at(t), "load", 9.0) for t in range(0, 60, 5)] + [(at(5), "disk", 1.0)], EVENTS)
    log = alert_log(events, RULES, 10, spark.createDataFrame([("high", at(55))], ACKS))
    assert [(r.rule_id, r.status, r.since) for r in open_alerts(log).collect()] == [("high", "acknowledged", at(40))]
    assert [tuple(r) for r in alert_stats(log).collect()] == [("critical", "acknowledged", 1)]


def test_stream_equals_batch_at_every_trigger_and_after_restarts(spark, tmp_path):
    events, acks = sample(3, 600)
    events.sort(key=lambda e: e[0])
    acks.sort(key=lambda a: a[1])
    cuts = [at(m) for m in (350, 700, 1000, 1300, 1700, 2100)]
    folder = {k: f"{tmp_path}/{k}" for k in ("events", "acks", "log", "checkpoint")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    before, seen, told = START, ([], []), 0
    for cut in cuts:
        part = [e for e in events if before <= e[0] < cut], [a for a in acks if before <= a[1] < cut]
        random.Random(4).shuffle(part[0])
        spark.createDataFrame(part[0], EVENTS).coalesce(1).write.mode("append").parquet(folder["events"])
        spark.createDataFrame(part[1], ACKS).coalesce(1).write.mode("append").parquet(folder["acks"])
        late = [] if cut == cuts[0] else [(at(2), "load", 99.0)]  # far behind the watermark
        if late:
            spark.createDataFrame(late, EVENTS).coalesce(1).write.mode("append").parquet(folder["events"])
        seen[0].extend(part[0])
        seen[1].extend(part[1])
        streams = [spark.readStream.schema(s).parquet(folder[k]) for k, s in (("events", EVENTS), ("acks", ACKS))]
        log = alert_stream(streams[0], RULES, 10, "30 minutes", streams[1])
        log.writeStream.format("parquet").option("checkpointLocation", folder["checkpoint"]).trigger(availableNow=True).start(folder["log"]).awaitTermination()
        newest = max([e[0] for e in seen[0] if e[1] is not None] + [a[1] for a in seen[1] if a[0] is not None])
        mark = ((newest - dt.datetime(1970, 1, 1)) // dt.timedelta(milliseconds=1) - 30 * 60 * 1000) * 1000
        want = rows(alert_log(spark.createDataFrame(seen[0], EVENTS), RULES, 10, spark.createDataFrame(seen[1], ACKS), mark))
        assert rows(spark.read.parquet(folder["log"])) == want
        assert len(want) >= told
        before, told = cut, len(want)
    assert told > 50
    assert spark.read.parquet(folder["log"]).where(F.col("at") > at(2100)).count() == 0


@pytest.mark.parametrize("spans", [1, 3])
def test_trailing_windows_over_stretches_are_those_over_all_events(spark, spans):
    from sparquill.operators.observe import trailing

    rng = random.Random(spans)
    events = [(n, START + dt.timedelta(seconds=rng.choice((0, 300, 600, 900, rng.randrange(20000)))), "hot" if n % 3 else "other", float(rng.randrange(50))) for n in range(600)]
    events += [(600 + n, None, "hot", 1.0) for n in range(3)]
    found = {r.event_id: (r.event_type, r.least, r.a.i, r.b.i, round(r["mean"], 9), r.n) for r in trailing(spark.createDataFrame(events, "event_id long, ts timestamp, event_type string, value double"), 5, spans).collect()}
    assert len(found) == len(events)
    for i, t, k, _v in events:
        reach = [(u, j, w) for j, u, m, w in events if m == k and (u is None if t is None else u is not None and 0 <= (t - u).total_seconds() <= 300)]
        order = sorted(reach, key=lambda x: (x[0] or START, x[1]))
        values = [w for _, _, w in reach]
        assert found[i] == (k, min(values), order[0][1], order[-1][1], round(sum(values) / len(values), 9), len(values))


@pytest.mark.parametrize("spans", [1, 4])
def test_trailing_windows_meet_each_event_twice_at_most(spark, spans):
    """Deviations of windows over two blocks, equal values, nulls; and no frame of the plan slides, which would read a window anew for each event."""
    from sparquill.operators.observe import trailing

    rng = random.Random(spans)
    values = [0.1, 0.1, 0.1, 0.1, 1e6 + 0.1, None]
    events = [(n, dt.datetime(1969, 12, 31, 23, 50) + dt.timedelta(seconds=rng.randrange(4000)), rng.choice(["a", "b", None]), rng.choice(values if n % 2 else values[:1])) for n in range(300)]
    events += [(300 + n, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=100 * n), "same", 0.1) for n in range(30)]
    table = spark.createDataFrame(events, "event_id long, ts timestamp, event_type string, value double")
    found = {r.event_id: r for r in trailing(table, 5, spans).collect()}
    assert len(found) == len(events)
    for i, t, k, _v in events:
        here = [(u, j, w) for j, u, m, w in events if m == k and 0 <= (t - u).total_seconds() <= 300]
        some = [w for *_, w in here if w is not None]
        r = found[i]
        assert (r.n, r.a.i, r.b.i, r.least) == (len(here), min(here, key=lambda x: x[:2])[1], max(here, key=lambda x: x[:2])[1], min(some, default=None))
        mean = sum(some) / len(some) if some else None
        assert (r["mean"] == pytest.approx(mean, rel=1e-12) if some else r["mean"] is None) and r.sd == (pytest.approx((sum((w - mean) ** 2 for w in some) / len(some)) ** 0.5, rel=1e-9) if len(set(some)) > 1 else 0.0 if some else None)
    frames = trailing(table, 5, spans)._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RangeFrame, unboundedpreceding$(), currentrow$())" in frames and "RangeFrame, -" not in frames
