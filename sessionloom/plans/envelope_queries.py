"""Envelope validity, encoding, spans, retry and dead-letter rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from sessionloom.functions.scalar import TRACE_PREFIX, dlq_topic, is_dlq, session_key, trace_id
from sessionloom.operators import envelope as env
from sessionloom.plans.catalog import Catalog
from sessionloom.plans.tables import EVENTS_SQL, events, keyed, with_messages

_c = Catalog()
QUERIES, ORACLE_SQL = _c.queries, _c.sql

#: Every event with a defect by its number: blank type, no agent, no project, a number as tenant, broken JSON.
_BROKEN = """broken AS (SELECT seq, CASE seq % 7 WHEN 1 THEN '  ' ELSE type END AS type, CASE seq % 7 WHEN 2 THEN '' ELSE agent_id END AS agent_id,
 CASE seq % 7 WHEN 3 THEN '' ELSE project END AS project, tenant, session_id, attempt, seq % 7 AS defect, payload FROM ev)"""


def _defective(spark, d):
    k = F.col("seq") % 7
    e = events(spark, d)
    return e.select(
        "seq", "topic", "tenant", "session_id", "attempt", "payload", k.alias("defect"),
        F.when(k == 1, "  ").otherwise(F.col("type")).alias("type"), F.when(k == 2, "").otherwise(F.col("agent_id")).alias("agent_id"), F.when(k == 3, "").otherwise(F.col("project")).alias("project"),
    )


def envelopes(spark, d):
    f = _defective(spark, d)
    e = {c: F.col(c) for c in ("type", "tenant", "project", "session_id", "agent_id", "attempt", "payload")} | {"version": F.lit("v1"), "step": F.lit(""), "created_at": F.lit("2026-04-03T10:00:00Z")}
    text = env.encode(e)
    text = F.when(F.col("defect") == 4, F.regexp_replace(text, '"tenant":"[^"]*"', '"tenant":5')).when(F.col("defect") == 5, F.concat(text, F.lit(" x"))).when(F.col("defect") == 6, F.concat(F.lit(" "), text)).otherwise(text)
    return f.select("seq", "topic", "defect", "tenant", text.alias("text"))


@_c.query(f"""WITH {EVENTS_SQL}, {_BROKEN} SELECT seq, CASE WHEN trim(type) = '' THEN 'event type is required' WHEN trim(tenant) = '' THEN 'event tenant is required' WHEN trim(project) = '' THEN 'event project is required'
 WHEN trim(session_id) = '' THEN 'event session_id is required' WHEN trim(agent_id) = '' THEN 'event agent_id is required' END AS error FROM broken""")
def validate_errors(spark, d):
    return _defective(spark, d).select("seq", env.error_of({c: F.col(c) for c in ("type", "tenant", "project", "session_id", "agent_id")}).alias("error"))


@_c.query(f"WITH {EVENTS_SQL} SELECT seq, seq % 7 NOT IN (1, 2, 3, 4, 5) AS is_event FROM ev")
def parse_event(spark, d):
    return env.with_validity(envelopes(spark, d), "text").select("seq", "is_event")


@_c.query(f"WITH {EVENTS_SQL} SELECT seq, seq % 7 NOT IN (4, 5, 6) AS can_peek FROM ev")
def peek_event(spark, d):
    return env.with_validity(envelopes(spark, d), "text").select("seq", "can_peek")


@_c.query(f"WITH {EVENTS_SQL} SELECT seq, seq % 7 NOT IN (4, 5) AS can_decode, CASE WHEN seq % 7 NOT IN (4, 5) THEN session_id END AS session_id FROM ev")
def decode_event(spark, d):
    return env.with_validity(envelopes(spark, d), "text").select("seq", "can_decode", F.when(F.col("can_decode"), F.col("e.session_id")).alias("session_id"))


@_c.query(f"WITH {EVENTS_SQL} SELECT seq, seq % 7 NOT IN (4, 5) AND tenant = 't2' AS fits FROM ev")
def session_filter(spark, d):
    return env.with_validity(envelopes(spark, d), "text").select("seq", env.filter_fits(tenant="t2").alias("fits"))


@_c.query(f"""WITH {EVENTS_SQL}, {_BROKEN} SELECT seq, '{{"version":"v1","type":"' || type || '","tenant":"' || tenant || '","project":"' || project || '","session_id":"' || session_id || '","agent_id":"' || agent_id || '","attempt":' || attempt || ',"created_at":"2026-04-03T10:00:00Z","payload":' || payload || '}}' AS text FROM broken WHERE defect <= 3""")
def encode_envelope(spark, d):
    return envelopes(spark, d).where("defect <= 3").select("seq", "text")


@_c.query(f"WITH {EVENTS_SQL} SELECT key, left(sha256('{TRACE_PREFIX}' || key), 32) AS trace_id FROM hashes")
def session_trace_id(spark, d):
    e = events(spark, d).select(session_key(F.col("tenant"), F.col("project"), F.col("session_id")).alias("key")).distinct()
    return e.select("key", trace_id(F.col("key")).alias("trace_id"))


@_c.query(f"""WITH {EVENTS_SQL} SELECT seq, left(sha256('{TRACE_PREFIX}' || key), 32) AS trace_id, x.k AS name, x.v AS value FROM keyed,
 LATERAL (VALUES ('agent.session.tenant', tenant), ('agent.session.project', project), ('agent.session.id', session_id), ('agent.event.type', type), ('agent.id', agent_id), ('agent.event.attempt', attempt::VARCHAR)) x(k, v)""")
def span_attributes(spark, d):
    e = events(spark, d).withColumn("step", F.lit(""))
    return env.spans(e).select("seq", "trace_id", F.explode("attributes").alias("name", "value"))


@_c.query(f"WITH {EVENTS_SQL} SELECT seq, 'web' AS tool, json_extract_string(payload, '$.k') AS call_id FROM ev WHERE type = 'click'")
def typed_payloads(spark, d):
    body = F.to_json(F.struct(F.lit("web").alias("tool"), F.get_json_object("payload", "$.k").alias("call_id")))
    e = events(spark, d).where(F.col("type") == "click").select("seq", F.lit("tool.call").alias("type"), body.alias("payload"))
    return env.typed_payload(e, "tool.call").select("seq", "typed.tool", "typed.call_id")


@_c.query(f"WITH {EVENTS_SQL} SELECT seq, greatest(attempt, 1) + 1 > 3 AS to_dlq, (greatest(attempt, 1) + 1)::BIGINT AS next_attempt, CASE WHEN greatest(attempt, 1) + 1 > 3 THEN topic || '.dlq' ELSE topic END AS target FROM ev WHERE topic = 'agent-events'")
def retry_route(spark, d):
    dead, following = env.next_attempt(F.col("attempt"), 3)
    e = events(spark, d).where(~is_dlq(F.col("topic")))
    return e.select("seq", dead.alias("to_dlq"), following.cast("long").alias("next_attempt"), F.when(dead, dlq_topic(F.col("topic"))).otherwise(F.col("topic")).alias("target"))


@_c.query(f"WITH {EVENTS_SQL} SELECT seq, a::BIGINT AS attempt, a > 3 AS dead FROM ev, LATERAL (SELECT unnest(range(attempt, 5)) AS a) WHERE topic = 'agent-events' AND a <= 4")
def retry_attempt_chain(spark, d):
    """Every attempt that an event which always fails goes through, up to the one that lands in the dead-letter topic."""
    e = events(spark, d).where(~is_dlq(F.col("topic")))
    chain = e.select("seq", F.explode(F.sequence(F.col("attempt"), F.lit(4).cast("long"))).alias("attempt"))
    return chain.select("seq", "attempt", (F.col("attempt") > 3).alias("dead"))


@_c.query("SELECT o_orderkey, CASE WHEN trim(o) = '' THEN t || '.dlq' ELSE trim(o) END AS dlq FROM (SELECT o_orderkey, 'orders-' || o_orderstatus AS t, CASE WHEN o_orderkey % 3 = 0 THEN ' custom-dlq ' ELSE ' ' END AS o FROM orders)")
def resolve_dlq_topic(spark, d):
    from sessionloom.plans.tables import table

    o = table(spark, d, "orders")
    override = F.when(F.col("o_orderkey") % 3 == 0, " custom-dlq ").otherwise(" ")
    return o.select("o_orderkey", dlq_topic(F.concat(F.lit("orders-"), F.col("o_orderstatus")), override).alias("dlq"))


@_c.query(f"""WITH {EVENTS_SQL}, w AS (SELECT seq, ([200, 204, 400, 408, 429, 500, 503])[(seq % 7 + 1)::INTEGER] AS status, attempt FROM ev),
 a AS (SELECT *, CASE WHEN status BETWEEN 200 AND 299 THEN 'done' WHEN status BETWEEN 400 AND 499 AND status NOT IN (408, 429) THEN 'drop' WHEN attempt >= 4 THEN 'drop' ELSE 'retry' END AS action FROM w)
 SELECT seq, action, (CASE WHEN action = 'retry' THEN least(30000, 500 * (2 ** (attempt - 1))) ELSE 0 END)::BIGINT AS wait_ms FROM a""")
def webhook_plan(spark, d):
    status = F.element_at(F.array(*map(F.lit, (200, 204, 400, 408, 429, 500, 503))), (F.col("seq") % 7 + 1).cast("int"))
    e = events(spark, d).withColumn("status", status)
    action, wait = env.deliver(F.col("status"), F.col("attempt"), 4)
    return e.select("seq", action.alias("action"), wait.alias("wait_ms"))


@_c.query(with_messages("""SELECT c.session_id, c."offset" AS call_offset, min(r."offset") AS result_offset FROM messages c JOIN messages r ON c.key = r.key AND c.topic = r.topic AND r."offset" > c."offset" AND c.type = 'click' AND r.type = 'purchase'
 AND json_extract_string(c.payload, '$.k') = json_extract_string(r.payload, '$.k') GROUP BY ALL"""))
def call_result_join(spark, d):
    """Extension: each call with the first later result of the same call id in its session."""
    from sessionloom.plans.tables import messages

    m = messages(spark, d).withColumn("call_id", F.get_json_object("payload", "$.k"))
    calls = m.where(F.col("type") == "click").select("key", "topic", "session_id", "call_id", F.col("offset").alias("call_offset"))
    results = m.where(F.col("type") == "purchase").select("key", "topic", "call_id", F.col("offset").alias("result_offset"))
    both = calls.join(results, ["key", "topic", "call_id"]).where("result_offset > call_offset")
    return both.groupBy("session_id", "topic", "key", "call_offset").agg(F.min("result_offset").alias("result_offset")).select("session_id", "call_offset", "result_offset")


__all__ = ["ORACLE_SQL", "QUERIES", "keyed"]
