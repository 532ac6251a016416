"""The agent-event envelope: parsing once into a struct, then four different validity predicates as native columns."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.scalar import session_key, trace_id, trimmed

FIELDS = ("version", "type", "tenant", "project", "session_id", "agent_id", "step", "created_at")
# Names of span attributes.
ATTRIBUTES = ("agent.session.tenant", "agent.session.project", "agent.session.id", "agent.id", "agent.event.type", "agent.event.step", "agent.event.attempt")
PARSED = ", ".join(f"{f} string" for f in FIELDS) + ", attempt long, payload string, whole boolean, peek boolean, brace boolean"
_INT64 = (-(1 << 63), (1 << 63) - 1)


def _no_constant(name: str):
    raise ValueError(name)


class _Number(str):
    """A JSON number as it was written."""


def _read(text: str | None) -> dict:
    """Fields of one payload. whole: every known field has its type; peek: the three filter fields have theirs."""
    out = dict.fromkeys(FIELDS) | {"attempt": 0, "payload": None, "whole": False, "peek": False, "brace": bool(text) and text[0] == "{"}
    out |= dict.fromkeys(FIELDS, "")
    if text is None:
        return out
    try:
        value = json.loads(text, parse_constant=_no_constant, parse_int=_Number, parse_float=_Number)
    except (ValueError, RecursionError):
        return out
    if value is None:
        return out | {"whole": True, "peek": True}
    if not isinstance(value, dict):
        return out
    good = {}
    for key, found in value.items():
        name = key.lower()
        if name in FIELDS:
            if found is None:
                good.setdefault(name, True)
            elif isinstance(found, str) and not isinstance(found, _Number):
                out[name], good[name] = found, good.get(name, True)
            else:
                good[name] = False
        elif name == "attempt" and found is not None:
            fits = isinstance(found, _Number) and found.lstrip("-").isdigit() and _INT64[0] <= int(found) <= _INT64[1]
            good[name] = fits and good.get(name, True)
            out["attempt"] = int(found) if fits else out["attempt"]
        elif name == "payload":
            out["payload"] = json.dumps(found, default=str)
    return out | {"whole": all(good.values()), "peek": all(good.get(f, True) for f in ("tenant", "project", "session_id"))}


def _read_all(payload: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_read(None if p is None or (isinstance(p, float) and math.isnan(p)) else p) for p in payload], columns=[c.split()[0] for c in PARSED.split(", ")])


def parse(payload: Column) -> Column:
    """The parsed struct of a payload, Arrow batch by batch."""
    return F.pandas_udf(_read_all, PARSED)(payload)


def error_of(e: dict[str, Column]) -> Column:
    """The first missing field's message, null for a valid event."""
    out = None
    for field, name in (("type", "type"), ("tenant", "tenant"), ("project", "project"), ("session_id", "session_id"), ("agent_id", "agent_id")):
        blank = F.coalesce(trimmed(e[field]), F.lit("")) == ""
        out = F.when(blank, f"event {name} is required") if out is None else out.when(blank, f"event {name} is required")
    return out


def with_validity(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds the parsed struct ``e`` and is_event, can_peek, can_decode."""
    out = df.withColumn("e", parse(F.col(payload).cast("string")))
    e = {f: F.col(f"e.{f}") for f in FIELDS}
    named = lambda *fields: F.array_min(F.array(*(F.length(e[f]) for f in fields))) > 0
    return out.withColumns(
        {
            "is_event": F.col("e.whole") & error_of(e).isNull(),
            "can_peek": F.col("e.brace") & F.col("e.whole") & named("tenant", "session_id", "type"),
            "can_decode": F.col("e.whole") & named("type", "tenant", "session_id"),
        }
    )


def filter_fits(tenant: str = "", project: str = "", session: str = "") -> Column:
    """The session filter over the parsed struct: no part asked for fits anything, JSON or not."""
    asked = {"tenant": tenant, "project": project, "session_id": session}
    if not any(asked.values()):
        return F.lit(True)
    out = F.col("e.peek")
    for field, value in asked.items():
        if value:
            out &= F.col(f"e.{field}") == value
    return out


def encode(e: dict[str, Column]) -> Column:
    """JSON text of an event: defaults filled in, step and attempt left out where they are empty."""
    payload = F.coalesce(e["payload"], F.lit("{}"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    pair = lambda name, c: F.concat(F.lit(f'"{name}":'), quoted(c))
    parts = [pair("version", F.coalesce(F.nullif(e["version"], F.lit("")), F.lit("v1")))]
    parts += [pair(f, e[f]) for f in ("type", "tenant", "project", "session_id", "agent_id")]
    parts.append(F.when(F.coalesce(e["step"], F.lit("")) != "", pair("step", e["step"])))
    parts.append(F.when(F.coalesce(e["attempt"], F.lit(0)) != 0, F.concat(F.lit('"attempt":'), e["attempt"].cast("string"))))
    parts += [pair("created_at", e["created_at"]), F.concat(F.lit('"payload":'), payload)]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def attributes(e: dict[str, Column]) -> Column:
    """Span attributes of an event: four always, the rest where set."""
    given = lambda c: F.nullif(c, F.lit(""))
    values = (e["tenant"], e["project"], e["session_id"], given(e["agent_id"]), e["type"], given(e["step"]), F.when(e["attempt"] > 0, e["attempt"].cast("string")))
    flat = [x for k, v in zip(ATTRIBUTES, values, strict=True) for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*flat), lambda _, v: v.isNotNull())


def spans(df: DataFrame) -> DataFrame:
    """One span a row: trace_id of its session and its attributes."""
    e = {f: F.col(f) for f in ("tenant", "project", "session_id", "type", "agent_id", "step", "attempt")}
    return df.select("seq", trace_id(session_key(e["tenant"], e["project"], e["session_id"])).alias("trace_id"), attributes(e).alias("attributes"))


TYPED = {
    "tool.call": "tool string, arguments string, call_id string",
    "tool.result": "call_id string, tool string, output string, error string, latency long",
    "token.chunk": "text string, index long, done boolean",
    "handoff": "from_agent string, to_agent string, reason string, context string",
}


def typed_payload(df: DataFrame, kind: str, payload: str = "payload") -> DataFrame:
    """Rows of one event type with its payload's fields."""
    return df.where(F.col("type") == kind).withColumn("typed", F.from_json(payload, TYPED[kind]))


def next_attempt(attempt: Column, most: Column | int) -> tuple[Column, Column]:
    """(to the dead-letter topic?, next attempt): the current one counts as 1 at least; a bound of 0 or less never gives up."""
    following = F.greatest(attempt, F.lit(1)) + 1
    bound = F.lit(most) if isinstance(most, int) else most
    return (bound > 0) & (following > bound), following


def deliver(status: Column, attempt: Column, most: int = 5, first_ms: int = 500, top_ms: int = 30_000) -> tuple[Column, Column]:
    """(action, wait in ms) after a delivery try: done on 2xx, gives up on other 4xx than 408 and 429 and after the last try."""
    bound = max(most, 1)
    done = (status >= 200) & (status < 300)
    permanent = (status >= 400) & (status < 500) & ~status.isin(408, 429)
    action = F.when(done, "done").when(permanent, "drop").when(attempt >= bound, "drop").otherwise("retry")
    wait = F.least(F.lit(float(top_ms)), F.lit(float(first_ms)) * F.pow(F.lit(2.0), attempt - 1)).cast("long")
    return action, F.when(action == "retry", wait).otherwise(0).cast("long")
