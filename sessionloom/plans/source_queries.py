"""Binary logs, offset files, snapshots and streams: written from the driver's tables, read back by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.plans.catalog import Catalog
from sessionloom.plans.log_queries import SESSION
from sessionloom.plans.tables import EVENTS_SQL, agent_events, keyed, messages, table, with_messages
from sessionloom.sources import files, shared
from sessionloom.streaming import pipeline

_c = Catalog()
QUERIES, ORACLE_SQL = _c.queries, _c.sql


def _wal(spark, d) -> str:
    """The events as write-ahead-log files, every third one without a key and every fifth with an explicit partition."""
    path = shared.fresh_path(spark, "wal")
    seq = F.col("seq")
    rows = keyed(spark, d).select(
        (F.unix_micros("ts") * 1000).alias("ts_ns"), "topic", F.when(seq % 3 == 0, "").otherwise(F.col("key")).alias("key"),
        F.when(seq % 5 == 0, seq % 3).otherwise(-1).cast("int").alias("partition"), F.to_json(F.struct("seq", "payload")).alias("payload"),
    )
    files.write_wal(rows, path)
    return path


_WRITTEN = """written AS (SELECT seq, ts, topic, CASE WHEN seq % 3 = 0 THEN '' ELSE key END AS k, (CASE WHEN seq % 5 = 0 THEN seq % 3 ELSE -1 END)::INTEGER AS explicit, h FROM keyed)"""


@_c.query(f"WITH {EVENTS_SQL}, {_WRITTEN} SELECT seq, 3 AS version, epoch_us(ts) * 1000 AS ts_ns, topic, k AS key, explicit AS partition FROM written")
def wal_scan(spark, d):
    seq = F.get_json_object(F.col("payload").cast("string"), "$.seq").cast("long")
    return files.wal(spark, _wal(spark, d)).select(seq.alias("seq"), "version", "ts_ns", "topic", "key", "partition")


@_c.query(f"""WITH {EVENTS_SQL}, {_WRITTEN}, placed AS (SELECT *, CASE WHEN explicit >= 0 THEN explicit WHEN k <> '' THEN (h % 3)::INTEGER ELSE 0 END AS partition FROM written)
 SELECT topic, partition, count(*) AS n, count(*) - 1 AS last_offset, min(ts) AS first_ts FROM placed GROUP BY ALL""")
def rebuilt_log(spark, d):
    """Start-up: the records placed again, numbered in the order in which the files hold them."""
    records = files.wal(spark, _wal(spark, d))
    log = files.rebuilt_log(records.withColumn("seq", F.get_json_object(F.col("payload").cast("string"), "$.seq").cast("long")))
    return log.groupBy("topic", "partition").agg(F.count("*").alias("n"), F.max("offset").alias("last_offset"), F.min("ts").alias("first_ts"))


@_c.query("""WITH r AS (SELECT l_suppkey % 4 AS shard_id, l_orderkey * 8 + l_linenumber AS v FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY v) - 1 AS "offset" FROM r)
 SELECT shard_id, "offset", v::VARCHAR AS payload FROM n WHERE "offset" >= 5""")
def shardwal_scan(spark, d):
    """Four shards' logs, read from their sixth record on."""
    path = shared.fresh_path(spark, "shards")
    number = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq")
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 4).alias("shard_id"), number)
    files.write_shard_wal(rows.withColumn("payload", F.col("seq").cast("string").cast("binary")), path)
    return files.shard_wal(spark, path, 5).select("shard_id", "offset", F.col("payload").cast("string").alias("payload"))


@_c.query(with_messages("SELECT topic, 'billing' AS grp, partition, max(\"offset\") + 1 AS committed FROM messages GROUP BY ALL"))
def group_offsets(spark, d):
    """Commits as an offsets file has them."""
    path = shared.fresh_path(spark, "offsets")
    tails = messages(spark, d).groupBy("topic", "partition").agg((F.max("offset") + 1).alias("committed"))
    files.write_group_offsets(tails.withColumn("grp", F.lit("billing")), path)
    return files.group_offsets(spark, path)


@_c.query("SELECT 'n' || n_nationkey AS node_id, 'a:' || n_name AS addr, 'c:' || n_regionkey AS client_addr FROM nation")
def cluster_snapshot(spark, d):
    """Members of a metadata snapshot."""
    path = shared.fresh_path(spark, "snapshot")
    members = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("k"), F.struct(F.concat(F.lit("a:"), "n_name").alias("addr"), F.concat(F.lit("c:"), "n_regionkey").alias("client_addr")).alias("v"))
    whole = members.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("members"), F.lit(2).alias("version"), F.lit(32).alias("shard_count"))
    whole.select(F.to_json(F.struct("version", "members", "shard_count")).alias("value")).write.text(path)
    return files.cluster_snapshot(spark, path)[0]


def _stream(spark, d):
    """The events as a stream of agent events."""
    reader = spark.readStream.schema(table(spark, d, "events").schema)
    # a stream watches a folder: the table's own, or that of its file
    if shared.is_folder(spark, f"{d}/events.parquet"):
        return agent_events(reader.parquet(f"{d}/events.parquet"))
    return agent_events(reader.option("pathGlobFilter", "events.parquet").parquet(d))


def _to_the_end(spark, stream, name: str):
    """What a stream appends until its input is read, as a table."""
    path = shared.fresh_path(spark, name)
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@_c.query(with_messages('SELECT seq, topic, partition, "offset" FROM messages'))
def stream_offsets(spark, d):
    """Offsets assigned by the stateful stream operator."""
    rows = pipeline.with_partition(_stream(spark, d)).select("seq", "topic", "partition")
    return _to_the_end(spark, pipeline.assign_offsets(rows), "stream-offsets")


@_c.query(f"WITH {EVENTS_SQL} SELECT seq, type, payload FROM ev WHERE tenant = 't2' AND project = 'support-bot' AND session_id = 'sess-42'")
def stream_tail(spark, d):
    return _to_the_end(spark, pipeline.tail_session(_stream(spark, d), *SESSION).select("seq", "type", "payload"), "stream-tail")


@_c.query(f"WITH {EVENTS_SQL} SELECT to_timestamp(epoch_us(ts) // 60000000 * 60)::TIMESTAMP AS window_start, topic, type, count(*) AS n FROM ev GROUP BY ALL")
def stream_counters(spark, d):
    """Windowed counts that the stream keeps up to date, as they are at its end."""
    counts = pipeline.event_rates(_stream(spark, d), "1 minute").select(F.col("window.start").alias("window_start"), "topic", "type", "n")
    path = shared.fresh_path(spark, "stream-counters")
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/now")
    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{path}/now")
