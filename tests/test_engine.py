"""Fixed cases of the event-log operators."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import scalar
from sessionloom.operators import envelope, log, metrics, routing
from sessionloom.plans import log_queries
from sessionloom.streaming import pipeline as streaming

BASE = {"version": "v1", "type": "tool.call", "tenant": "acme", "project": "bot", "session_id": "s1", "agent_id": "a", "attempt": 2, "created_at": "2026-04-03T10:00:00Z", "payload": {"tool": "search"}}


def event(**change):
    return json.dumps({k: v for k, v in (BASE | change).items() if v != "absent"})


MATRIX = {
    "full": (event(), "TTTT"), "empty_obj": ("{}", "FFFF"), "not_json": ("not json", "FFFF"), "empty": ("", "FFFF"), "array": ("[1,2,3]", "FFFF"), "null": ("null", "FFFF"),
    "no_agent": (event(agent_id="absent"), "FTTT"), "agent_null": (event(agent_id=None), "FTTT"), "no_project": (event(project="absent"), "FTTT"), "blank_type": (event(type="  "), "FTTT"),
    "tenant_num": (event(tenant=5), "FFFF"), "attempt_str": (event(attempt="2"), "FFFT"), "attempt_half": (event(attempt=1.5), "FFFT"), "attempt_float": (event().replace('"attempt": 2', '"attempt": 2.0'), "FFFT"),
    "attempt_exp": (event().replace('"attempt": 2', '"attempt": 1e2'), "FFFT"), "attempt_big": (event(attempt=1 << 63), "FFFT"), "step_num": (event(step=3), "FFFT"), "attempt_null": (event(attempt=None), "TTTT"),
    "no_payload": (event(payload="absent"), "TTTT"), "extra": (event(extra={"k": 1}), "TTTT"), "lead_space": (" " + event(), "TFTT"), "key_case": (event().replace('"tenant"', '"Tenant"'), "TTTT"),
    "dup_tenant": (event().replace('"tenant"', '"tenant": "x", "tenant"'), "TTTT"), "padded": (event(tenant=" acme "), "TTTF"), "session_null": (event(session_id=None), "FFFT"),
    "truncated": (event()[:-1], "FFFF"), "trailing": (event() + " x", "FFFF"), "two_docs": (event() * 2, "FFFF"), "nan": (event().replace('"attempt": 2', '"attempt": NaN'), "FFFF"), "lead_zero": (event().replace('"attempt": 2', '"attempt": 02'), "FFFF"),
    "raw_tab": (event().replace("search", "sea\trch"), "FFFF"), "single": (event().replace('"', "'"), "FFFF"),
}


def test_validity_matrix(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in MATRIX.items()], "name string, payload string")
    out = envelope.with_validity(df).select("name", "is_event", "can_peek", "can_decode", envelope.filter_fits(tenant="acme").alias("fits")).collect()
    found = {r.name: "".join("FT"[bool(x)] for x in r[1:]) for r in out}
    assert {k: found[k] for k in MATRIX if found[k] != MATRIX[k][1]} == {}
    assert envelope.with_validity(df).where(envelope.filter_fits()).count() == len(MATRIX)


def test_hash_goldens(spark):
    golden = {"acme/support-bot/sess-42": 2090472779, "acme/bot/sess-42": 2236343541, "user-42": 39875499, "payment-service": 1654154407, "default": 2470140894, "é/ü/x": 4081399618, "": 2166136261}
    df = spark.createDataFrame([(k,) for k in golden], "k string")
    assert {r.k: r.h for r in df.select("k", scalar.fnv1a32(F.col("k")).alias("h")).collect()} == golden
    scalar.register(spark)
    assert {r.k: r.h for r in df.selectExpr("k", "fnv1a32(k) as h").collect()} == golden
    assert spark.sql("select session_trace_id(session_key(' acme', 'bot', 'sess-42 ')), partition_for('user-42', 8)").first()[:] == (hashlib.sha256(b"session/acme/bot/sess-42").hexdigest()[:32], 3)


def test_ring_goldens(spark):
    nodes = lambda names: spark.createDataFrame([(n,) for n in names], "node_id string")
    shards = spark.range(100).withColumnRenamed("id", "shard_id")
    owners = {r.shard_id: r.node_id for r in routing.ring_owner(nodes(["n1", "n2", "n3"]), shards).collect()}
    assert [owners[k] for k in range(8)] == ["n1", "n2", "n3", "n1", "n2", "n2", "n2", "n2"]
    before = {r.shard_id: r.node_id for r in routing.ring_owner(nodes(["n1", "n2", "n3"]), shards, 64).collect()}
    after = {r.shard_id: r.node_id for r in routing.ring_owner(nodes(["n1", "n3"]), shards, 64).collect()}
    assert "n2" not in after.values() and sum(before[k] != after[k] for k in before) == 16


def ring(spark, n, cap):
    rows = spark.range(n).select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("seq"), F.lit("x").alias("payload"), F.timestamp_seconds("id").alias("ts"))
    return log.assign_offsets(rows, chunk=7)


@pytest.mark.parametrize("cap, n, head, evicted", [(1024, 10, 0, 0), (64, 84, 20, 20), (32, 39, 7, 7)])
def test_retention(spark, cap, n, head, evicted):
    d = log.partition_detail(ring(spark, n, cap), cap).first()
    assert (d["head"], d["tail"], d["evictions"]) == (head, n, evicted)
    page = log.rpc_fetch(ring(spark, n, cap), "t", 0, 0, cap, cap).orderBy("offset").collect()
    assert [r.offset for r in page] == list(range(head, n)) and all(r.next_offset == n for r in page)
    assert log.rpc_fetch(ring(spark, n, cap), "t", 99).count() == 0


def test_filtered_paging_misses_nothing(spark):
    rows = ring(spark, 1024, 4096).withColumn("tenant", F.when(F.col("seq") % 5 < 3, "a").otherwise("b"))
    got, at = [], 0
    while at < 1024:
        page = log.fetch_filtered(rows, "t", 0, at, log.session_is(tenant="a"), 256, 16384).orderBy("offset").collect()
        if not page:
            break
        got += [r.offset for r in page]
        at = page[0].next_offset
    assert got == [k for k in range(1024) if k % 5 < 3]


def test_retry_rules(spark):
    rows = [(1, 3), (3, 3), (4, 0), (0, 3), (-5, 1)]
    dead, following = envelope.next_attempt(F.col("a"), F.col("m"))
    out = spark.createDataFrame(rows, "a long, m long").select(dead, following).collect()
    assert [tuple(r) for r in out] == [(False, 2), (True, 4), (False, 5), (False, 2), (True, 2)]


def test_cluster_rules(spark):
    shards = spark.range(4).withColumnRenamed("id", "shard_id")
    alive = spark.createDataFrame([("n1",), ("n2",)], "node_id string")
    none = spark.createDataFrame([], "shard_id long, node_id string")
    assert sorted(r.node_id for r in routing.assign(shards, none, alive).collect()) == ["n1", "n1", "n2", "n2"]
    dead = spark.createDataFrame([(0, "n2"), (1, "n2")], "shard_id long, node_id string")
    assert {r.node_id for r in routing.assign(shards.limit(2), dead, alive.where("node_id = 'n1'")).collect()} == {"n1"}
    replicas = spark.createDataFrame([(0, "self"), (0, "n2"), (0, "n3")], "shard_id long, replica string")
    acks = spark.createDataFrame([(0, "self", 5), (0, "n2", 3), (0, "n3", 4), (0, "gone", 1)], "shard_id long, replica string, acked long")
    assert metrics.high_water_mark(replicas, acks).first().mark == 3


def test_command_fold(spark):
    commands = [
        (1, "register_member", "n1", "a1", "c1", None), (2, "add_member", "n1", "a2", None, None), (3, "add_member", "n2", "b", None, None), (4, "register_member", "n4", "d", "c4", None),
        (5, "set_shard_leader", "n4", None, None, 5), (6, "remove_member", "n4", None, None, None), (7, "add_member", "n4", "d2", None, None), (8, "add_member", "", "x", None, None),
        (9, "set_shard_leader", "n3", None, None, 7), (10, "set_shard_leader", "", None, None, 7), (11, "remove_member", "n2", None, None, None), (12, "set_shard_count", None, None, None, 32),
    ]
    members, leaders, count = metrics.fold_commands(spark.createDataFrame(commands, "seq long, op string, node_id string, addr string, client_addr string, shard long"))
    # adding keeps a registered client address, unless the member was removed in between
    assert sorted(map(tuple, members.collect())) == [("n1", "a2", "c1"), ("n4", "d2", None)]
    assert [tuple(r) for r in leaders.collect()] == [(7, "n3")] and [tuple(r) for r in count.collect()] == [(32,)]


def test_bulk_counters(spark):
    dead = F.col("id") % 10 == 0
    payload = F.when(dead, event(attempt=2)).otherwise(event(attempt=1))
    payload = F.when(F.col("id") >= 40_000, F.element_at(F.array(*map(F.lit, ("not json", "{}", event(agent_id="absent"), event(type="  "), event(tenant=5)))), (F.col("id") % 5 + 1).cast("int"))).otherwise(payload)
    log_rows = spark.range(40_010).select(F.when(dead, "agent-events.dlq").otherwise("agent-events").alias("topic"), payload.alias("payload"), F.lit("other").alias("type"))
    out = {(r.topic, r.type): (r.published, r.retries, r.dlq) for r in metrics.agent_counters(log_rows).collect()}
    assert out == {("agent-events", "tool.call"): (36000, 0, 0), ("agent-events.dlq", "tool.call"): (4000, 4000, 4000)}


def test_requests_are_checked(spark):
    rows = ring(spark, 10, 64)
    for topic, partition in (("", 0), ("t", -1)):
        with pytest.raises(ValueError):
            log.rpc_fetch(rows, topic, partition)
    assert log.http_fetch(rows, "t", 0, 0).count() == 10 and log.http_fetch(rows, "t", 0, 0, 0).count() == 0


def long_log(spark, partition):
    """Offsets 0 to 199, and one more than the default capacity later."""
    rows = spark.range(200).union(spark.range(log.CAPACITY + 500, log.CAPACITY + 501))
    return rows.select(F.lit("agent-events").alias("topic"), F.lit(partition).alias("partition"), F.col("id").alias("offset"), F.timestamp_seconds("id").alias("ts"), F.lit("{}").alias("payload"))


def test_http_fetch_reads_a_log_longer_than_the_ring(spark, monkeypatch):
    monkeypatch.setattr(log_queries, "messages", lambda spark, d: long_log(spark, 2))
    assert sorted(r.offset for r in log_queries.http_fetch(spark, "").collect()) == list(range(3, 103))
    # by itself the operator keeps the ring's capacity
    assert log.http_fetch(long_log(spark, 2), "agent-events", 2, 3, 500).count() == 0


def test_tcp_fetch_reads_a_log_longer_than_the_ring(spark, monkeypatch):
    monkeypatch.setattr(log_queries, "messages", lambda spark, d: long_log(spark, 0))
    assert sorted(r.offset for r in log_queries.tcp_fetch(spark, "").collect()) == list(range(20, 120))
    # by itself the operator keeps the ring's capacity
    assert log.tcp_fetch(long_log(spark, 0), "agent-events", 20, 100).count() == 0


def test_stored_log_is_pruned(spark, tmp_path):
    rows = ring(spark, 100, 64).withColumns({"tenant": F.lit("a"), "project": F.lit("p"), "session_id": F.lit("s")})
    log.store(rows, str(tmp_path / "log"), 10)
    kept = spark.read.schema(rows.schema).parquet(str(tmp_path / "log"))
    assert sorted(map(tuple, kept.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    replayed = log.session_replay(kept, "a", "p", "s", 0, "t", 5)
    plan = spark._jvm.PythonSQLUtils.explainString(replayed._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(topic" in plan and "GreaterThanOrEqual(offset,5)" in plan, plan


def test_stream_offsets_equal_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "seq long, topic string, tenant string, project string, session_id string"
    rows = [(k, "t", "a", "p", f"s{k % 7}") for k in range(60)]
    df = spark.createDataFrame(rows, schema)
    for a, b in ((0, 25), (25, 60)):
        df.where(f"seq >= {a} and seq < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.assign_offsets(streaming.with_partition(stream)).writeStream.format("memory").queryName("ingested").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = log.assign_offsets(streaming.with_partition(df))
    key = lambda d: sorted((r.partition, r.offset) for r in d.collect())
    assert key(spark.table("ingested")) == key(batch)
    got, commits = [], []
    q = streaming.consume(spark.readStream.schema("topic string, partition int, offset long, payload string").parquet(_log(spark, tmp_path)), "g", lambda b: got.extend(b.collect()), lambda c: commits.extend(c.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(got) == 5 and [tuple(c) for c in commits] == [("t", "g", 0, 5)]


def _log(spark, tmp_path):
    spark.createDataFrame([("t", 0, k, "x") for k in range(5)], "topic string, partition int, offset long, payload string").write.parquet(str(tmp_path / "log"))
    return str(tmp_path / "log")


def test_webhook_tries():
    waits, statuses = [], iter([500, 429, 200])
    assert streaming.deliver_row({"partition": 0, "offset": 1, "payload": b"{}"}, "u", {}, lambda *_: next(statuses), sleep=waits.append) == ("done", 3)
    assert waits == [0.5, 1.0]
    assert streaming.deliver_row({"partition": 0, "offset": 1, "payload": "x"}, "u", {}, lambda *_: 404) == ("drop", 1)
    assert streaming.deliver_row({"partition": 0, "offset": 1, "payload": None}, "u", {}, lambda *_: 503, most=0, sleep=waits.append) == ("drop", 1)


def test_log_rendering(spark):
    r = spark.sql("select timestamp'2024-01-01 10:20:30.123' ts, 7L offset, 'tool.call' type, 'search' step, 2L attempt, 'planner' agent_id")
    line = lambda df: df.select(log.pretty({c: F.col(c) for c in df.columns})).first()[0]
    assert line(r) == "[10:20:30.123] off=7      tool.call      search (attempt 2)  agent=planner"
    plain = r.withColumns({"step": F.lit(""), "attempt": F.lit(1), "ts": F.lit(None).cast("timestamp"), "created_at": F.expr("timestamp'2024-01-01 00:00:01'")})
    assert line(plain) == "[00:00:01.000] off=7      tool.call       agent=planner"
    body = lambda text: line(r.withColumn("payload", F.lit(text))).split("agent=planner", 1)[1]
    assert body('{"b":[1.50,{}],"a":"x, {y}"}') == '\n    {\n      "b": [\n        1.50,\n        {}\n      ],\n      "a": "x, {y}"\n    }'
    assert body("not json") == "\n    not json" and body("") == "" and body("x" * 4096) == "" and body("[]") == "\n    []"
    e = {k: F.lit(v) if not isinstance(v, dict) else F.lit(json.dumps(v)) for k, v in BASE.items()} | {"step": F.lit("")}
    assert json.loads(spark.range(1).select(envelope.encode(e)).first()[0]) == BASE
