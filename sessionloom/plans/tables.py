"""The driver's tables as an event log: messages with session columns, partition and offset; and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.scalar import AGENT_TOPIC, DLQ_SUFFIX, fnv1a32, session_key
from sessionloom.operators.log import assign_offsets, store
from sessionloom.sources import shared

TENANTS, PARTITIONS, DLQ_EVERY = 5, 3, 10


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir: str) -> DataFrame:
    """The events table as agent events, in the order of event_id."""
    return agent_events(table(spark, sf_dir, "events"))


def agent_events(t: DataFrame) -> DataFrame:
    """The same of any rows like the events table's, a stream's too."""
    topic = F.when(F.col("event_id") % DLQ_EVERY == 0, AGENT_TOPIC + DLQ_SUFFIX).otherwise(AGENT_TOPIC)
    return t.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("props").alias("payload"), "user_id", topic.alias("topic"),
        F.concat(F.lit("t"), (F.col("user_id") % TENANTS).cast("string")).alias("tenant"), F.lit("support-bot").alias("project"),
        F.concat(F.lit("sess-"), F.col("user_id").cast("string")).alias("session_id"), F.lit("planner").alias("agent_id"),
        F.col("event_type").alias("type"), (1 + F.col("event_id") % 4).cast("long").alias("attempt"),
    )


def keyed(spark, sf_dir: str) -> DataFrame:
    """Events with their session's key and the key's hash, row by row: no session gathers in one task."""
    e = events(spark, sf_dir).withColumn("key", session_key(F.col("tenant"), F.col("project"), F.col("session_id")))
    return e.withColumn("h", fnv1a32(F.col("key"))).withColumn("partition", (F.col("h") % PARTITIONS).cast("int"))


def messages(spark, sf_dir: str) -> DataFrame:
    """The numbered log, stored once a session by topic, partition and offset."""
    log = assign_offsets(keyed(spark, sf_dir))
    return shared.kept(spark, "log", f"{sf_dir}/events.parquet", lambda path: store(log, path), log.schema)


FNV_SQL = "list_reduce(list_prepend(2166136261::UBIGINT, list_transform({octets}, lambda c: c::UBIGINT)), lambda h, b: (xor(h, b) * 16777619::UBIGINT) & 4294967295::UBIGINT)"


def fnv_sql(text: str) -> str:
    """For ASCII text."""
    return FNV_SQL.format(octets=f"list_transform(string_split({text}, ''), lambda x: ascii(x))")


EVENTS_SQL = f"""ev AS (SELECT event_id AS seq, ts, value, props AS payload, user_id,
  CASE WHEN event_id % 10 = 0 THEN 'agent-events.dlq' ELSE 'agent-events' END AS topic,
  't' || (user_id % 5) AS tenant, 'support-bot' AS project, 'sess-' || user_id AS session_id, 'planner' AS agent_id,
  event_type AS type, 1 + event_id % 4 AS attempt FROM events),
hashes AS (SELECT DISTINCT user_id AS u, tenant || '/' || project || '/' || session_id AS key, {fnv_sql("tenant || '/' || project || '/' || session_id")} AS h FROM (SELECT DISTINCT user_id, tenant, project, session_id FROM ev)),
keyed AS (SELECT ev.*, key, h, (h % 3)::INTEGER AS partition FROM ev JOIN hashes ON u = user_id),
messages AS (SELECT *, (row_number() OVER (PARTITION BY topic, partition ORDER BY seq) - 1)::BIGINT AS "offset" FROM keyed)"""


def with_messages(sql: str) -> str:
    return f"WITH {EVENTS_SQL} {sql}"
