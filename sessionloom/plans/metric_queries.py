"""Counters, lag, rates, quantiles, alerts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sessionloom.functions.scalar import short_number, uptime
from sessionloom.operators import log, metrics
from sessionloom.plans.catalog import Catalog
from sessionloom.plans.envelope_queries import envelopes
from sessionloom.plans.tables import EVENTS_SQL, events, messages, table, with_messages

_c = Catalog()
QUERIES, ORACLE_SQL = _c.queries, _c.sql

KEPT = 1000
_DETAIL = f'detail AS (SELECT topic, partition, greatest(max("offset") + 1 - {KEPT}, 0) AS head, max("offset") + 1 AS tail FROM messages GROUP BY ALL)'
#: Consumer groups of the lag queries: how far each has committed, as a share of the tail in tenths.
_GROUPS = [("billing", 10), ("audit", 7), ("slow", 0)]
_COMMITS = "commits AS (SELECT topic, partition, grp, tail * tenths // 10 AS committed, head, tail FROM detail, (VALUES ('billing', 10), ('audit', 7), ('slow', 0)) g(grp, tenths))"
_LAG = "SELECT topic, grp, partition, greatest(CASE WHEN committed < head THEN tail - head ELSE tail - committed END, 0)::BIGINT AS lag FROM commits"
BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)
_SPAN = "86400"


def _epoch(width: str) -> str:
    return f"to_timestamp(epoch_us(ts) // 1000000 // {width} * {width})::TIMESTAMP"


@_c.query(f"""WITH {EVENTS_SQL} SELECT topic, type, count(*) AS published, count(*) FILTER (attempt > 1) AS retries, count(*) FILTER (topic LIKE '%.dlq') AS dlq
 FROM ev WHERE seq % 7 NOT IN (1, 2, 3, 4, 5) GROUP BY ALL""")
def agent_counters(spark, d):
    return metrics.agent_counters(envelopes(spark, d), "text")


def _lag(spark, d):
    detail = log.partition_detail(messages(spark, d), KEPT)
    groups = spark.createDataFrame(_GROUPS, "grp string, tenths long")
    commits = detail.crossJoin(F.broadcast(groups)).select("topic", "grp", "partition", F.floor(F.col("tail") * F.col("tenths") / 10).cast("long").alias("committed"))
    return metrics.lag(detail, commits)


@_c.query(with_messages(f", {_DETAIL}, {_COMMITS} {_LAG}"))
def consumer_lag(spark, d):
    return _lag(spark, d)


@_c.query(with_messages(f", {_DETAIL}, {_COMMITS} SELECT topic, grp, max(lag)::BIGINT AS lag FROM ({_LAG}) GROUP BY topic, grp"))
def max_lag_by(spark, d):
    return _lag(spark, d).groupBy("topic", "grp").agg(F.max("lag").alias("lag"))


@_c.query(with_messages(f", {_DETAIL} SELECT topic, max((tail - head) / {KEPT}.0::DOUBLE * 100) AS fill_pct, CASE WHEN max(tail - head) > {KEPT} * 0.8 THEN 'red' WHEN max(tail - head) > {KEPT} * 0.5 THEN 'yellow' ELSE 'green' END AS colour FROM detail GROUP BY topic"))
def fill_pct(spark, d):
    worst = log.partition_detail(messages(spark, d), KEPT).groupBy("topic").agg(F.max("fill_pct").alias("fill_pct"))
    return worst.withColumn("colour", metrics.fill_colour(F.col("fill_pct")))


_HISTOGRAM = f"""hist AS (SELECT type, b AS le, count(*) FILTER (value <= b) AS n FROM ev, LATERAL (SELECT unnest([{", ".join(f"{b}::DOUBLE" for b in BOUNDS)}, 'inf'::DOUBLE]) AS b) GROUP BY ALL)"""


@_c.query(f"WITH {EVENTS_SQL}, {_HISTOGRAM} SELECT type, CASE WHEN le < 'inf'::DOUBLE THEN le END AS le, n FROM hist")
def latency_histogram(spark, d):
    return metrics.histogram(events(spark, d), "value", BOUNDS, "type").select("type", "le", "n")


@_c.query(f"""WITH {EVENTS_SQL}, {_HISTOGRAM}, w AS (SELECT type, le, n, coalesce(lag(le) OVER (PARTITION BY type ORDER BY le), 0) AS low, coalesce(lag(n) OVER (PARTITION BY type ORDER BY le), 0) AS below, max(n) OVER (PARTITION BY type) AS alln FROM hist)
SELECT type, round(min(low + (CASE WHEN le = 'inf'::DOUBLE THEN 0 ELSE le - low END) * (0.95 * alln - below) / (n - below)), 9) AS p95 FROM w WHERE n >= 0.95 * alln AND below < 0.95 * alln GROUP BY type""")
def histogram_quantile_p95(spark, d):
    buckets = metrics.histogram(events(spark, d), "value", BOUNDS, "type").select("type", "le", "n")
    return metrics.histogram_quantile(buckets, 0.95, "type").select("type", F.round("quantile", 9).alias("p95"))


@_c.query(f"WITH {EVENTS_SQL} SELECT topic, {_epoch('60')} AS window_start, count(*) AS n, count(*) / 60.0::DOUBLE AS rate FROM ev GROUP BY ALL")
def rate_1m(spark, d):
    return metrics.event_rate(events(spark, d), "1 minute", "topic")


@_c.query(f"""WITH {EVENTS_SQL}, s AS (SELECT user_id, ts, seq, (row_number() OVER (PARTITION BY user_id ORDER BY seq)) % 20 AS value FROM ev),
 st AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM s)
 SELECT user_id, {_epoch(_SPAN)} AS window_start, sum(CASE WHEN p IS NULL THEN 0 WHEN value >= p THEN value - p ELSE value END)::DOUBLE / {_SPAN} AS rate FROM st GROUP BY ALL""")
def counter_rate_with_resets(spark, d):
    value = (F.row_number().over(Window.partitionBy("user_id").orderBy("seq")) % 20).cast("double")
    samples = events(spark, d).select("user_id", "ts", value.alias("value"))
    return metrics.counter_rate(samples, "1 day", "user_id")


@_c.query(f"""WITH {EVENTS_SQL}, w AS (SELECT topic, type, {_epoch(_SPAN)} AS window_start, count(*) AS published, count(*) FILTER (attempt > 1) AS retries FROM ev GROUP BY ALL)
 SELECT topic, type, window_start, published, retries, retries / published::DOUBLE AS ratio FROM w WHERE retries / published::DOUBLE > 0.8""")
def retry_storm_alert(spark, d):
    return metrics.retry_ratio_alerts(events(spark, d), "1 day", 0.8)


@_c.query(f"WITH {EVENTS_SQL} SELECT topic, {_epoch('300')} AS window_start, count(*) AS dlq FROM ev WHERE topic LIKE '%.dlq' GROUP BY ALL")
def dlq_alert(spark, d):
    return metrics.dlq_alerts(events(spark, d), "5 minutes")


@_c.query("""WITH w AS (SELECT DISTINCT epoch_us(ts) // 1000000 // 300 * 300 AS s FROM events), spine AS (SELECT unnest(range((SELECT min(s) FROM w), (SELECT max(s) FROM w) + 1, 300)) AS s)
 SELECT to_timestamp(s)::TIMESTAMP AS window_start FROM spine WHERE s NOT IN (SELECT s FROM w)""")
def silence_alert(spark, d):
    return metrics.silent_windows(events(spark, d), 300)


@_c.query(f"""WITH {EVENTS_SQL}, w AS (SELECT {_epoch(_SPAN)} AS window_start, count(*) AS n FROM ev GROUP BY ALL), b AS (SELECT *, coalesce(lag(n) OVER (ORDER BY window_start), 0)::BIGINT AS before FROM w)
 SELECT *, CASE WHEN n > before THEN ' ↑' WHEN n < before THEN ' ↓' ELSE '' END AS trend FROM b""")
def throughput_trend(spark, d):
    return metrics.throughput_trend(events(spark, d), "1 day")


_SHORT = "CASE WHEN {0} <= 0 THEN '0' WHEN {0} >= 1000000000 THEN format('{{:.1f}}B', {0} / 1e9) WHEN {0} >= 1000000 THEN format('{{:.1f}}M', {0} / 1e6) WHEN {0} >= 1000 THEN format('{{:.1f}}K', {0} / 1e3) ELSE {0}::VARCHAR END"


@_c.query(f"""WITH {EVENTS_SQL}, c AS (SELECT tenant, count(*) AS published, count(*) FILTER (type IN ('click', 'view')) AS consumed FROM ev GROUP BY tenant), b AS (SELECT *, greatest(published - consumed, 0) AS backlog FROM c)
 SELECT tenant, published, consumed, backlog, CASE WHEN backlog > 100000 THEN 'red' WHEN backlog > 1000 THEN 'yellow' ELSE 'green' END AS colour, {_SHORT.format('backlog')} AS shown FROM b""")
def backlog(spark, d):
    c = events(spark, d).groupBy("tenant").agg(F.count("*").alias("published"), F.count_if(F.col("type").isin("click", "view")).alias("consumed"))
    waiting, colour = metrics.backlog(F.col("published"), F.col("consumed"))
    return c.select("tenant", "published", "consumed", waiting.alias("backlog"), colour.alias("colour"), short_number(waiting).alias("shown"))


@_c.query("""SELECT event_type AS type, q, v[1 + floor(q * (len(v) - 1))::INTEGER] AS value FROM (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL), (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) t(q)""")
def nearest_rank_quantile(spark, d):
    return metrics.nearest_rank(events(spark, d), "value", (0.5, 0.95, 0.99), "type")


@_c.query("""SELECT c_custkey, CASE WHEN c_custkey // 3600 > 0 THEN (c_custkey // 3600) || 'h ' || (c_custkey % 3600 // 60) || 'm ' || (c_custkey % 60) || 's' WHEN c_custkey // 60 > 0 THEN (c_custkey // 60) || 'm ' || (c_custkey % 60) || 's' ELSE c_custkey || 's' END AS uptime FROM customer""")
def format_uptime(spark, d):
    return table(spark, d, "customer").select("c_custkey", uptime(F.col("c_custkey")).alias("uptime"))


@_c.query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g) SELECT user_id, min(ts) AS start_ts, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_activity(spark, d):
    """Extension: bursts of a user's activity with gaps under 30 minutes."""
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start_ts"), "n")


@_c.query(f"WITH {EVENTS_SQL} SELECT tenant, type, count(*) AS n, sum(octet_length(payload::BLOB))::BIGINT AS bytes FROM ev GROUP BY ROLLUP (tenant, type)")
def usage_rollup(spark, d):
    """Extension: rows and payload bytes by tenant and type with subtotals."""
    return events(spark, d).rollup("tenant", "type").agg(F.count("*").alias("n"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"))
