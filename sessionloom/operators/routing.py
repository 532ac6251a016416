"""Where keys, sessions, groups and shards go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.scalar import bucket_of, fnv1a32, fold_bytes, little_endian, octets_of
from sessionloom.operators.log import numbered

PARTITIONS, SHARDS, VNODES = 3, 32, 128


def round_robin(df: DataFrame, count: int, order: str = "seq", chunk: int = 1_000_000) -> DataFrame:
    """Unkeyed rows take the partitions of their topic in turn; keyed ones go by hash and don't advance the turn."""
    keyless = F.coalesce(F.col("key"), F.lit("")) == ""
    turn = numbered(df.where(keyless), ("topic",), order, chunk, "turn").withColumn("partition", (F.col("turn") % count).cast("int")).drop("turn")
    return df.where(~keyless).withColumn("partition", bucket_of(F.col("key"), count)).unionByName(turn.select(*df.columns, "partition"))


def channel_partition(channel: Column, key: Column, explicit: Column, turn: Column, count: int) -> Column:
    """The partition that each way in uses: rpc takes an explicit one, else the key, else turns; http an explicit one over
    zero, else the key, else 0; tcp the key, else 0."""
    keyed = F.coalesce(key, F.lit("")) != ""
    by_key = bucket_of(F.coalesce(key, F.lit("")), count)
    rpc = F.when(explicit >= 0, explicit).when(keyed, by_key).otherwise((turn % count).cast("int"))
    http = F.when(explicit > 0, explicit).when(keyed, by_key).otherwise(0)
    return F.when(channel == "rpc", rpc).when(channel == "http", http).otherwise(F.when(keyed, by_key).otherwise(0)).cast("int")


def route(sessions: DataFrame, leaders: DataFrame, alive: DataFrame, members: DataFrame, own: str, shards: int = SHARDS) -> DataFrame:
    """Adds shard_id, leader, leader_addr, is_local: a shard without a live leader has neither leader nor address."""
    live = leaders.join(alive, leaders["node_id"] == alive["node_id"], "left_semi")
    found = live.join(members.select(F.col("node_id").alias("__m"), "client_addr"), F.col("node_id") == F.col("__m"), "left").select(F.col("shard_id").alias("__s"), "node_id", "client_addr")
    out = sessions.withColumn("shard_id", bucket_of(F.col("key"), shards).cast("long")).join(found, F.col("shard_id") == F.col("__s"), "left")
    return out.select(*sessions.columns, "shard_id", F.coalesce("node_id", F.lit("")).alias("leader"), F.coalesce("client_addr", F.lit("")).alias("leader_addr"), F.coalesce(F.col("node_id") == own, F.lit(False)).alias("is_local"))


def ring_owner(nodes: DataFrame, shards: DataFrame, vnodes: int = VNODES) -> DataFrame:
    """(shard_id, node_id): the node of the first ring position at or after a shard's, around the end to the first of all.

    A forward as-of join: positions and shards in one sorted sequence, cut by position so that no task sorts them all.
    """
    spots = nodes.crossJoin(F.broadcast(nodes.sparkSession.range(vnodes).withColumnRenamed("id", "v")))
    spots = spots.select("node_id", fold_bytes(F.concat(little_endian(F.col("v")), octets_of(F.col("node_id")))).alias("pos")).groupBy("pos").agg(F.max("node_id").alias("node_id"))
    asked = shards.select("shard_id", fold_bytes(F.concat(little_endian(F.col("shard_id")), octets_of(F.lit("shard")))).alias("pos"))
    # the ring is nodes x vnodes positions: an array on the driver's side of the plan, searched by each shard
    ring = spots.agg(F.sort_array(F.collect_list(F.struct("pos", "node_id"))).alias("ring"))
    at = F.coalesce(F.try_element_at(F.filter("ring", lambda x: x["pos"] >= F.col("pos")), F.lit(1)), F.col("ring")[0])
    return asked.crossJoin(F.broadcast(ring)).select("shard_id", at["node_id"].alias("node_id"))


def assign(shards: DataFrame, leaders: DataFrame, alive: DataFrame) -> DataFrame:
    """(shard_id, node_id) for shards without a live leader: the live nodes in order, in turn."""
    live = leaders.join(alive, "node_id", "left_semi")
    free = shards.join(live, "shard_id", "left_anti")
    nodes = alive.select("node_id", (F.row_number().over(Window.orderBy("node_id")) - 1).alias("place"), F.count("*").over(Window.partitionBy()).alias("k"))
    turns = free.select("shard_id", (F.row_number().over(Window.orderBy("shard_id")) - 1).alias("turn"))
    return turns.join(nodes, F.col("turn") % F.col("k") == F.col("place")).select("shard_id", "node_id")


def ensure_topics(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """Topics that exist keep their number of partitions; new ones get theirs, 3 where it isn't positive."""
    new = wanted.join(existing, "topic", "left_anti").select("topic", F.when(F.col("n_partitions") > 0, F.col("n_partitions")).otherwise(PARTITIONS).cast("int").alias("n_partitions"))
    return existing.select("topic", "n_partitions").unionByName(new)


__all__ = ["PARTITIONS", "SHARDS", "VNODES", "assign", "bucket_of", "channel_partition", "ensure_topics", "fnv1a32", "ring_owner", "round_robin", "route"]
