"""Counters, gauges, histograms and the time-series questions asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.scalar import is_dlq, trend
from sessionloom.operators.envelope import with_validity

BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
ROLES = ("Follower", "Candidate", "Leader", "Shutdown")


def agent_counters(log: DataFrame, payload: str = "payload") -> DataFrame:
    """published, retries and dlq by topic and type in one pass over (topic, payload); a row may count in all three, and a
    payload that isn't a valid event counts in none."""
    events = with_validity(log.select("topic", payload), payload).where("is_event").select("topic", "e.type", "e.attempt")
    return events.groupBy("topic", "type").agg(F.count("*").alias("published"), F.count_if(F.col("attempt") > 1).alias("retries"), F.count_if(is_dlq(F.col("topic"))).alias("dlq"))


def start_offset(committed: Column, tail: Column) -> Column:
    return F.coalesce(committed, tail)


def lag(detail: DataFrame, committed: DataFrame) -> DataFrame:
    """topic, grp, partition, lag: rows behind the tail; behind the whole retained range where the commit is older than it."""
    behind = F.when(F.col("committed") < F.col("head"), F.col("tail") - F.col("head")).otherwise(F.col("tail") - F.col("committed"))
    return committed.join(detail, ["topic", "partition"]).select("topic", "grp", "partition", F.greatest(behind, F.lit(0)).cast("long").alias("lag"))


def histogram(df: DataFrame, value: str, bounds: tuple[float, ...], *by: str) -> DataFrame:
    """Cumulative counts by bucket bound, the last one infinite (null), with sum and count beside: one aggregation."""
    counts = F.array(*(F.struct(F.lit(b).cast("double").alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in bounds), F.struct(F.lit(None).cast("double").alias("le"), F.count(value).alias("n")))
    out = df.groupBy(*by).agg(counts.alias("b"), F.sum(value).alias("total"), F.count(value).alias("observed"))
    return out.select(*by, F.explode("b").alias("x"), "total", "observed").select(*by, "x.le", "x.n", "total", "observed")


def histogram_quantile(buckets: DataFrame, q: float, *by: str) -> DataFrame:
    """Linear interpolation in the bucket that holds the quantile; the last finite bound where that is the infinite one."""
    w = Window.partitionBy(*by).orderBy(F.col("le").asc_nulls_last())
    out = buckets.withColumns({"low": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "below": F.coalesce(F.lag("n").over(w), F.lit(0)), "all": F.max("n").over(Window.partitionBy(*by))})
    rank = F.lit(q) * F.col("all")
    inside = F.col("low") + (F.coalesce("le", "low") - F.col("low")) * (rank - F.col("below")) / (F.col("n") - F.col("below"))
    return out.where((F.col("n") >= rank) & (F.col("below") < rank)).groupBy(*by).agg(F.min(inside).alias("quantile"))


def counter_rate(samples: DataFrame, width: str, *by: str) -> DataFrame:
    """Increase a second in fixed windows of a counter's samples (ts, value); a fall is a restart and counts from zero."""
    before = F.lag("value").over(Window.partitionBy(*by).orderBy("ts"))
    step = F.when(before.isNull(), 0.0).when(F.col("value") >= before, F.col("value") - before).otherwise(F.col("value"))
    seconds = (F.unix_timestamp("w.end") - F.unix_timestamp("w.start")).cast("double")
    return samples.withColumn("step", step).groupBy(*by, F.window("ts", width).alias("w")).agg(F.sum("step").alias("increase")).select(*by, F.col("w.start").alias("window_start"), (F.col("increase") / seconds).alias("rate"))


def event_rate(events: DataFrame, width: str, *by: str) -> DataFrame:
    """Events a second in fixed windows, straight from the log."""
    seconds = (F.unix_timestamp("w.end") - F.unix_timestamp("w.start")).cast("double")
    return events.groupBy(*by, F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("window_start"), "n", (F.col("n") / seconds).alias("rate"))


def retry_ratio_alerts(events: DataFrame, width: str, bound: float) -> DataFrame:
    """Windows, by topic and type, in which more than ``bound`` of the published events were retries."""
    w = events.groupBy("topic", "type", F.window("ts", width).alias("w")).agg(F.count("*").alias("published"), F.count_if(F.col("attempt") > 1).alias("retries"))
    return w.where(F.col("retries") / F.col("published") > bound).select("topic", "type", F.col("w.start").alias("window_start"), "published", "retries", (F.col("retries") / F.col("published")).alias("ratio"))


def dlq_alerts(events: DataFrame, width: str) -> DataFrame:
    return events.where(is_dlq(F.col("topic"))).groupBy("topic", F.window("ts", width).alias("w")).agg(F.count("*").alias("dlq")).select("topic", F.col("w.start").alias("window_start"), "dlq")


def silent_windows(events: DataFrame, seconds: int) -> DataFrame:
    """Windows between the first and the last event in which nothing was published."""
    at = (F.floor(F.unix_timestamp("ts") / seconds) * seconds).cast("long")
    bounds = events.agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a is not null")
    spine = bounds.select(F.explode(F.sequence("a", "b", F.lit(seconds).cast("long"))).alias("s"))
    busy = events.select(at.alias("s")).distinct()
    return spine.join(busy, "s", "left_anti").select(F.timestamp_seconds("s").alias("window_start"))


def throughput_trend(events: DataFrame, width: str) -> DataFrame:
    """Each window's count, the one before and the direction."""
    w = event_rate(events, width).select("window_start", "n")
    before = F.coalesce(F.lag("n").over(Window.orderBy("window_start")), F.lit(0)).cast("long")
    return w.withColumn("before", before).withColumn("trend", trend(F.col("n"), F.col("before")))


def backlog(published: Column, consumed: Column) -> tuple[Column, Column]:
    """(rows waiting, colour of the panel)."""
    waiting = F.greatest(published - consumed, F.lit(0))
    return waiting, F.when(waiting > 100_000, "red").when(waiting > 1_000, "yellow").otherwise("green")


def fill_colour(pct: Column) -> Column:
    return F.when(pct > 80, "red").when(pct > 50, "yellow").otherwise("green")


def nearest_rank(df: DataFrame, value: str, quantiles: tuple[float, ...], *by: str) -> DataFrame:
    """value at rank floor(q * (n - 1)) of the sorted values, by q, from a count of each distinct value, not of the rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by).orderBy(value))
    placed = counts.withColumns({"upto": upto, "n": F.sum("c").over(Window.partitionBy(*by))})
    asked = placed.withColumn("q", F.explode(F.array(*map(F.lit, quantiles)))).withColumn("rank", F.floor(F.col("q") * (F.col("n") - 1)))
    return asked.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c"))).select(*by, "q", F.col(value).alias("value"))


def role_rows(states: DataFrame) -> DataFrame:
    """Four rows a node, 1 for the role it has."""
    return states.select("node", F.explode(F.array(*map(F.lit, ROLES))).alias("role"), F.col("state")).select("node", "role", (F.col("role") == F.col("state")).cast("int").alias("value"))


def leader_changes(samples: DataFrame) -> DataFrame:
    """How often each node saw the leader change, from (node, seq, leader)."""
    before = F.lag("leader").over(Window.partitionBy("node").orderBy("seq"))
    return samples.withColumn("before", before).groupBy("node").agg(F.count_if(F.col("before").isNotNull() & (F.col("leader") != F.col("before"))).alias("changes"))


def high_water_mark(replicas: DataFrame, acks: DataFrame) -> DataFrame:
    """(shard_id, mark): the least of the replicas' highest acknowledged counts; a replica without one holds it at 0."""
    best = acks.groupBy("shard_id", "replica").agg(F.max("acked").alias("acked"))
    return replicas.join(best, ["shard_id", "replica"], "left").groupBy("shard_id").agg(F.min(F.coalesce("acked", F.lit(0))).cast("long").alias("mark"))


def fold_commands(commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, shard leaders, shard count) after a command log of (seq, op, node_id, addr, client_addr, shard).

    Adding a member keeps the client address that it has registered; registering sets both; removing it forgets both and clears
    the shards that it then leads. Commands that need a node id and have none change nothing. No count set gives no row.
    """
    named = commands.where("node_id <> ''")
    gone = named.where("op = 'remove_member'").groupBy(F.col("node_id").alias("gone")).agg(F.max("seq").alias("gone_at"))
    present = named.where("op in ('add_member', 'register_member')").join(gone, F.col("node_id") == F.col("gone"), "left")
    registered = F.max_by("client_addr", F.when(F.col("op") == "register_member", F.col("seq"))).alias("client_addr")
    members = present.where("gone_at is null or seq > gone_at").groupBy("node_id").agg(F.max_by("addr", "seq").alias("addr"), registered)
    leads = named.where("op = 'set_shard_leader'").groupBy("shard").agg(F.max_by("node_id", "seq").alias("node_id"), F.max("seq").alias("set_at"))
    kept = leads.join(gone, (F.col("node_id") == F.col("gone")) & (F.col("gone_at") > F.col("set_at")), "left_anti")
    count = commands.where("op = 'set_shard_count'").agg(F.max_by("shard", "seq").cast("long").alias("shard_count")).where("shard_count is not null")
    return members, kept.select(F.col("shard").alias("shard_id"), "node_id"), count
