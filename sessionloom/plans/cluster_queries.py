"""Shards, leaders, ring, replicas and the command log."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.functions.scalar import header_pair
from sessionloom.operators import metrics, routing
from sessionloom.plans.catalog import Catalog
from sessionloom.plans.tables import EVENTS_SQL, FNV_SQL, keyed, table

_c = Catalog()
QUERIES, ORACLE_SQL = _c.queries, _c.sql

NODES = ["n1", "n2", "n3"]
#: A small cluster: shards 0..31 led in turn by n1..n4, every seventh unassigned; n2 is dead; n3 has no client address.
_LEADERS = "leaders AS (SELECT s AS shard_id, 'n' || (s % 4 + 1) AS node_id FROM range(32) t(s) WHERE s % 7 <> 0)"
_ALIVE = "alive AS (SELECT * FROM (VALUES ('n1'), ('n3'), ('n4')) a(node_id))"
_MEMBERS = "members AS (SELECT * FROM (VALUES ('n1', 'n1:9095'), ('n2', 'n2:9095'), ('n3', NULL), ('n4', 'n4:9095')) m(node_id, client_addr))"
_CLUSTER = f"{_LEADERS}, {_ALIVE}, {_MEMBERS}"


def _cluster(spark):
    s = spark.range(32).withColumnRenamed("id", "shard_id")
    leaders = s.where(F.col("shard_id") % 7 != 0).select("shard_id", F.concat(F.lit("n"), (F.col("shard_id") % 4 + 1).cast("string")).alias("node_id"))
    alive = spark.createDataFrame([("n1",), ("n3",), ("n4",)], "node_id string")
    members = spark.createDataFrame([("n1", "n1:9095"), ("n2", "n2:9095"), ("n3", None), ("n4", "n4:9095")], "node_id string, client_addr string")
    return s, leaders, alive, members


@_c.query(f"""WITH {EVENTS_SQL}, {_CLUSTER} SELECT key, h % 32 AS shard_id, coalesce(l.node_id, '') AS leader, coalesce(m.client_addr, '') AS leader_addr, coalesce(l.node_id = 'n1', false) AS is_local
 FROM hashes LEFT JOIN (SELECT * FROM leaders WHERE node_id IN (SELECT node_id FROM alive)) l ON l.shard_id = h % 32 LEFT JOIN members m ON m.node_id = l.node_id""")
def route_session(spark, d):
    _, leaders, alive, members = _cluster(spark)
    return routing.route(keyed(spark, d).select("key").distinct(), leaders, alive, members, "n1")


def _le32(x: str) -> str:
    return f"[{x} & 255, ({x} >> 8) & 255, ({x} >> 16) & 255, ({x} >> 24) & 255]"


_RING = f"""ring AS (SELECT {FNV_SQL.format(octets="list_concat(" + _le32("v") + ", list_transform(string_split(node, ''), lambda x: ascii(x)::BIGINT))")} AS pos, max(node) AS node FROM (VALUES ('n1'), ('n2'), ('n3')) n(node), range(128) t(v) GROUP BY pos)"""


@_c.query(f"""WITH {_RING}, k AS (SELECT s_suppkey AS shard_id, {FNV_SQL.format(octets="list_concat(" + _le32("s_suppkey") + ", list_transform(string_split('shard', ''), lambda x: ascii(x)::BIGINT))")} AS pos FROM supplier),
 o AS (SELECT shard_id, arg_min(node, r.pos) AS node FROM k LEFT JOIN ring r ON r.pos >= k.pos GROUP BY shard_id) SELECT shard_id, coalesce(node, (SELECT arg_min(node, pos) FROM ring)) AS node_id FROM o""")
def hash_ring_owner(spark, d):
    nodes = spark.createDataFrame([(n,) for n in NODES], "node_id string")
    return routing.ring_owner(nodes, table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("shard_id")))


@_c.query(f"""WITH {_CLUSTER}, free AS (SELECT s AS shard_id, row_number() OVER (ORDER BY s) - 1 AS turn FROM range(32) t(s) WHERE s NOT IN (SELECT shard_id FROM leaders WHERE node_id IN (SELECT node_id FROM alive))),
 n AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS place FROM alive) SELECT shard_id, node_id FROM free JOIN n ON turn % 3 = place""")
def assign_shards(spark, d):
    s, leaders, alive, _ = _cluster(spark)
    return routing.assign(s, leaders, alive)


@_c.query("SELECT 'orders-' || o_orderstatus AS topic, CASE o_orderstatus WHEN 'F' THEN 5 ELSE 3 END::INTEGER AS n_partitions FROM (SELECT DISTINCT o_orderstatus FROM orders)")
def ensure_topic(spark, d):
    topics = table(spark, d, "orders").select(F.concat(F.lit("orders-"), F.col("o_orderstatus")).alias("topic")).distinct()
    existing = spark.createDataFrame([("orders-F", 5)], "topic string, n_partitions int")
    return routing.ensure_topics(existing.join(topics, "topic", "left_semi"), topics.withColumn("n_partitions", F.when(F.col("topic") == "orders-F", 9).otherwise(0)))


@_c.query(f"WITH {_CLUSTER} SELECT node_id, client_addr FROM members WHERE client_addr IS NOT NULL AND node_id IN (SELECT node_id FROM alive)")
def alive_members(spark, d):
    _, _, alive, members = _cluster(spark)
    return members.where("client_addr is not null").join(alive, "node_id", "left_semi")


@_c.query("""WITH acks AS (SELECT l_orderkey % 32 AS shard_id, 'n' || (l_suppkey % 3 + 1) AS replica, l_linenumber::BIGINT AS acked FROM lineitem),
 reps AS (SELECT s AS shard_id, 'n' || r AS replica FROM range(32) t(s), range(1, 4) u(r)) SELECT shard_id, min(coalesce(a, 0))::BIGINT AS mark FROM reps LEFT JOIN (SELECT shard_id, replica, max(acked) AS a FROM acks GROUP BY ALL) USING (shard_id, replica) GROUP BY shard_id""")
def high_water_mark(spark, d):
    lines = table(spark, d, "lineitem")
    acks = lines.select((F.col("l_orderkey") % 32).alias("shard_id"), F.concat(F.lit("n"), (F.col("l_suppkey") % 3 + 1).cast("string")).alias("replica"), F.col("l_linenumber").cast("long").alias("acked"))
    replicas = spark.range(32).select(F.col("id").alias("shard_id"), F.explode(F.array(*map(F.lit, NODES))).alias("replica"))
    return metrics.high_water_mark(replicas, acks)


_STATE = "states AS (SELECT 'n' || (c_nationkey % 4 + 1) AS node, max_by(c_mktsegment, c_custkey) AS seg FROM customer GROUP BY 1)"
_ROLE = "CASE WHEN seg IN ('BUILDING', 'MACHINERY') THEN 'Leader' WHEN seg = 'AUTOMOBILE' THEN 'Candidate' ELSE 'Follower' END"


@_c.query(f"WITH {_STATE} SELECT node, role, ({_ROLE} = role)::INTEGER AS value FROM states, (VALUES ('Follower'), ('Candidate'), ('Leader'), ('Shutdown')) r(role)")
def leader_one_hot(spark, d):
    seg = F.max_by("c_mktsegment", "c_custkey")
    state = F.when(F.col("seg").isin("BUILDING", "MACHINERY"), "Leader").when(F.col("seg") == "AUTOMOBILE", "Candidate").otherwise("Follower")
    states = table(spark, d, "customer").groupBy(F.concat(F.lit("n"), (F.col("c_nationkey") % 4 + 1).cast("string")).alias("node")).agg(seg.alias("seg")).withColumn("state", state)
    return metrics.role_rows(states)


@_c.query("""WITH s AS (SELECT 'n' || (user_id % 3 + 1) AS node, event_id AS seq, event_type AS leader FROM events), w AS (SELECT node, leader, lag(leader) OVER (PARTITION BY node ORDER BY seq) AS before FROM s)
 SELECT node, count(*) FILTER (before IS NOT NULL AND leader <> before) AS changes FROM w GROUP BY node""")
def leader_changes(spark, d):
    samples = table(spark, d, "events").select(F.concat(F.lit("n"), (F.col("user_id") % 3 + 1).cast("string")).alias("node"), F.col("event_id").alias("seq"), F.col("event_type").alias("leader"))
    return metrics.leader_changes(samples)


_COMMANDS = """cmds AS (SELECT event_id AS seq, CASE event_id % 10 WHEN 0 THEN 'remove_member' WHEN 1 THEN 'add_member' WHEN 2 THEN 'register_member' WHEN 3 THEN 'set_shard_count' ELSE 'set_shard_leader' END AS op,
 CASE WHEN event_id % 50 = 1 THEN '' ELSE 'n' || (user_id % 9) END AS node_id, 'a' || event_id AS addr, CASE WHEN event_id % 10 = 2 THEN 'c' || event_id END AS client_addr, event_id % 32 AS shard FROM events),
 gone AS (SELECT node_id, max(seq) AS at FROM cmds WHERE op = 'remove_member' GROUP BY node_id)"""


def _commands(spark, d):
    k = F.col("event_id") % 10
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.when(k == 0, "remove_member").when(k == 1, "add_member").when(k == 2, "register_member").when(k == 3, "set_shard_count").otherwise("set_shard_leader").alias("op"),
        F.when(F.col("event_id") % 50 == 1, "").otherwise(text("n", F.col("user_id") % 9)).alias("node_id"), text("a", F.col("event_id")).alias("addr"), F.when(k == 2, text("c", F.col("event_id"))).alias("client_addr"), (F.col("event_id") % 32).alias("shard"),
    )


@_c.query(f"""WITH {_COMMANDS}, alive AS (SELECT c.* FROM cmds c LEFT JOIN gone g USING (node_id) WHERE c.node_id <> '' AND c.op IN ('add_member', 'register_member') AND c.seq > coalesce(g.at, -1))
 SELECT node_id, arg_max(addr, seq) AS addr, arg_max(client_addr, seq) FILTER (op = 'register_member') AS client_addr FROM alive GROUP BY node_id""")
def fold_members(spark, d):
    return metrics.fold_commands(_commands(spark, d))[0]


@_c.query(f"""WITH {_COMMANDS}, s AS (SELECT shard, arg_max(node_id, seq) AS node_id, max(seq) AS at FROM cmds WHERE op = 'set_shard_leader' AND node_id <> '' GROUP BY shard)
 SELECT shard AS shard_id, node_id FROM s WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.node_id = s.node_id AND g.at > s.at)""")
def fold_shard_leaders(spark, d):
    return metrics.fold_commands(_commands(spark, d))[1]


@_c.query(f"WITH {_COMMANDS} SELECT arg_max(shard, seq)::BIGINT AS shard_count FROM cmds WHERE op = 'set_shard_count' HAVING count(*) > 0")
def fold_shard_count(spark, d):
    return metrics.fold_commands(_commands(spark, d))[2]


@_c.query("""SELECT p_partkey, CASE WHEN position(':' IN x) > 1 AND position(':' IN x) < length(x) THEN left(x, position(':' IN x) - 1) END AS name, CASE WHEN position(':' IN x) > 1 AND position(':' IN x) < length(x) THEN ltrim(substr(x, position(':' IN x) + 1), ' ' || chr(9)) END AS value
 FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'X-Part: ' || p_partkey WHEN 1 THEN ':' || p_partkey WHEN 2 THEN 'X-Empty:' ELSE 'A:b:' || p_partkey END AS x FROM part)""")
def parse_headers(spark, d):
    k, n = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    line = F.when(k == 0, F.concat(F.lit("X-Part: "), n)).when(k == 1, F.concat(F.lit(":"), n)).when(k == 2, F.lit("X-Empty:")).otherwise(F.concat(F.lit("A:b:"), n))
    return table(spark, d, "part").select("p_partkey", line.alias("x")).select("p_partkey", header_pair(F.col("x")).alias("p")).select("p_partkey", "p.name", "p.value")


@_c.query("""SELECT a.l_orderkey AS shard_offset FROM (SELECT DISTINCT l_orderkey FROM lineitem) a WHERE a.l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')""")
def orphan_shard_records(spark, d):
    """Records of a shard's log that never reached the published log: here, line items of orders that aren't open."""
    shard = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("shard_offset")).distinct()
    published = table(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("shard_offset"))
    return shard.join(published, "shard_offset", "left_anti")
