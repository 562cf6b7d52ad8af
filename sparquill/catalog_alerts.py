"""Queries over alerts: their log from all events, the open ones, their counts, and the same as a stream, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .catalog import _events, query  # noqa: PLC2701
from .plans.rounds import shared_folder
from .streaming.alerts import MINUTE, Rule, alert_log, alert_stats, alert_stream, open_alerts
from .streaming.events import read_events

RULES = (
    Rule("errors_high", "error", "threshold", "gt", 40.0, 60, 180, "critical"),
    Rule("errors_steady", "error", "threshold", "ge", 30.0, 240, 600, "high", resolves=False),
    Rule("views_low", "view", "threshold", "lt", 60.0, 120, 60, "low"),
    Rule("clicks_rise", "click", "rate", "gt", 0.4, 180, 120, "medium"),
    Rule("purchases_fall", "purchase", "rate", "le", -0.3, 120, 0, "high"),
    Rule("signups_odd", "signup", "anomaly", "", 2.5, 1440, 60, "medium"),
    Rule("signups_any", "signup", "threshold", "ne", 0.0, 60, 1440, "low"),
    Rule("errors_unwatched", "error", "threshold", "gt", 0.0, 60, enabled=False),
)
EVERY, LATE = 60, "6 hours"
_DESK = 50  # users whose number is a multiple of this acknowledge the alerts of what they meet
_SIGN = {"gt": ">", "lt": "<", "ge": ">=", "le": "<="}


def _acks(events):
    """An acknowledgement of every rule on an event's type, where the user is of the desk."""
    metric = F.create_map(*(F.lit(x) for r in RULES for x in (r.rule_id, r.metric)))
    met = F.filter(F.map_keys(metric), lambda r: metric[r] == F.col("event_type"))
    return events.where(F.col("user_id") % _DESK == 0).select("ts", F.explode(met).alias("rule_id"))


def _walk(until: str) -> str:
    """SQL of the log up to an instant: conditions by joins, states of alerts by recursion over each rule's changes in order."""
    rules = ", ".join(f"('{r.rule_id}', '{r.metric}', '{r.kind}', '{r.operator}', {r.bound}::DOUBLE, {r.minutes}, {r.cooldown}, '{r.severity}', {r.resolves})" for r in RULES if r.enabled)
    compare = lambda v: "CASE op " + " ".join(f"WHEN '{o}' THEN {v} {s} bound" for o, s in _SIGN.items()) + f" WHEN 'ne' THEN abs({v} - bound) >= 2.220446049250313e-16 END"
    return f"""
WITH RECURSIVE rule(rule_id, metric, kind, op, bound, minutes, cooldown, severity, resolves) AS (VALUES {rules}),
e AS (SELECT ts, user_id, event_type, value, time_bucket(INTERVAL {EVERY} MINUTE, ts) + INTERVAL {EVERY} MINUTE AS tm FROM events WHERE ts IS NOT NULL),
lim AS (SELECT {until} AS until FROM e),
tick AS (SELECT event_type, tm, avg(value) AS v, row_number() OVER (PARTITION BY event_type ORDER BY tm) AS seen FROM e, lim WHERE value IS NOT NULL AND tm <= until GROUP BY event_type, tm),
seen AS (SELECT r.*, a.tm, a.v, a.seen, b.tm AS bat, b.v AS bv FROM rule r JOIN tick a ON a.event_type = metric JOIN tick b ON b.event_type = metric AND b.tm BETWEEN a.tm - to_minutes(minutes) AND a.tm),
reach AS (SELECT rule_id, kind, op, bound, tm, v, seen, bool_and({compare("bv")}) AS every_one, count(*) AS n, min(bat) AS since, arg_min(bv, bat) AS first, avg(bv) AS mean, stddev_pop(bv) AS sd FROM seen GROUP BY ALL),
judged AS (SELECT rule_id, tm, v, CASE kind WHEN 'threshold' THEN every_one WHEN 'rate' THEN n >= 2 AND whole > 0 AND {compare("((v - first) / nullif(whole, 0))")} ELSE seen >= 10 AND n >= 5 AND sd > 0 AND abs(v - mean) / nullif(sd, 0) > bound END AS holds FROM (SELECT *, date_diff('minute', since, tm) AS whole FROM reach)),
gone AS (SELECT rule_id, tm + to_minutes(minutes + {EVERY}) AS tm, lead(tm) OVER (PARTITION BY rule_id ORDER BY tm) AS next FROM judged JOIN rule USING (rule_id)),
change AS (
  SELECT rule_id, tm, 0 AS k, v, coalesce(holds, false) AS holds FROM judged
  UNION ALL SELECT rule_id, tm, 1, NULL, false FROM gone, lim WHERE tm <= until AND (next IS NULL OR next > tm)
  UNION ALL SELECT rule_id, min(ts), 2, NULL, false FROM e JOIN rule ON metric = event_type, lim WHERE user_id % {_DESK} = 0 AND tm <= until GROUP BY rule_id, tm),
step AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY tm, k) AS n FROM change),
walk AS (
  SELECT rule_id, 0::BIGINT AS n, NULL::TIMESTAMP AS raised, false AS known, NULL::VARCHAR AS status, NULL::TIMESTAMP AS tm, NULL::DOUBLE AS v FROM rule
  UNION ALL
  SELECT s.rule_id, s.n,
    CASE WHEN k = 2 THEN raised WHEN NOT holds THEN NULL WHEN raised IS NULL OR raised + to_minutes(cooldown) <= s.tm THEN s.tm ELSE raised END,
    CASE WHEN k = 2 THEN raised IS NOT NULL WHEN NOT holds OR raised IS NULL OR raised + to_minutes(cooldown) <= s.tm THEN false ELSE known END,
    CASE WHEN k = 2 THEN CASE WHEN raised IS NOT NULL AND NOT known THEN 'acknowledged' END
         WHEN holds THEN CASE WHEN raised IS NULL OR raised + to_minutes(cooldown) <= s.tm THEN 'triggered' END
         WHEN raised IS NOT NULL THEN CASE WHEN resolves AND NOT known THEN 'resolved' ELSE 'closed' END END,
    s.tm, s.v
  FROM walk JOIN step s ON s.rule_id = walk.rule_id AND s.n = walk.n + 1 JOIN rule r ON r.rule_id = s.rule_id),
log AS (SELECT rule_id, metric, severity, status, tm, round(v, 6) AS value, n FROM walk JOIN rule USING (rule_id) WHERE status IS NOT NULL),
live AS (SELECT rule_id, metric, severity, arg_max(status, n) AS status, max(tm) FILTER (status = 'triggered') AS since, max(tm) AS changed FROM log GROUP BY ALL)
"""


_END, _MARK = "max(tm)", f"date_trunc('millisecond', max(ts)) - INTERVAL {LATE}"
_LOG = """SELECT rule_id, metric, severity, status, strftime(tm, '%Y-%m-%d %H:%M:%S') AS "at", value FROM log"""


def _shown(log):
    return log.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


@query(_walk(_END) + _LOG)
def alert_life(spark, d):
    """Every change of every rule's alerts."""
    events = _events(spark, d)
    return _shown(alert_log(events, RULES, EVERY, _acks(events)))


@query(_walk(_END) + "SELECT rule_id, metric, severity, status, strftime(since, '%Y-%m-%d %H:%M:%S') AS since, strftime(changed, '%Y-%m-%d %H:%M:%S') AS changed FROM live WHERE status IN ('triggered', 'acknowledged')")
def alert_open(spark, d):
    """The alerts that are open after the last event."""
    events = _events(spark, d)
    still = open_alerts(alert_log(events, RULES, EVERY, _acks(events)))
    return still.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("since", "changed")})


@query(_walk(_END) + "SELECT severity, status, count(*) AS n FROM live WHERE status IN ('triggered', 'acknowledged') GROUP BY 1, 2")
def alert_counts(spark, d):
    """How many alerts of each severity and status are open after the last event."""
    events = _events(spark, d)
    return alert_stats(alert_log(events, RULES, EVERY, _acks(events)))


@query(_walk(_MARK) + _LOG)
def alert_life_streamed(spark, d):
    """Every change up to the last watermark, from a stream over the table that ends when all is read."""
    table = _events(spark, d)
    events = read_events(spark, f"{d}/events.parque[t]", table.schema)  # a pattern, since a stream takes no single file
    root = f"{shared_folder(spark)}/sparquill/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(path)
    files.deleteOnExit(path)  # what is left goes when the session ends
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        log = alert_stream(events, RULES, EVERY, LATE, _acks(events))
        log.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/log").awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return _shown(spark.read.schema(log.schema).parquet(f"{root}/log"))
