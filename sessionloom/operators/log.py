"""The partitioned log: offsets, count-based retention, offset-range reads, statistics."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.functions.scalar import clamp_count

CAPACITY = 1 << 20
#: The capacity of a log that evicts nothing.
UNBOUNDED = (1 << 63) - 1
KEYS = ("topic", "partition")


def numbered(df: DataFrame, keys: tuple[str, ...], order: str, chunk: int, name: str) -> DataFrame:
    """0, 1, ... in order of a whole-number column within each key, without sorting a key in one task.

    Rows are numbered inside chunks of the order column; a chunk's start is the number of rows in the chunks before it,
    from one aggregation. Ties in the order column are an error of the input.
    """
    part = F.floor(F.col(order) / chunk).alias("__chunk")
    marked = df.withColumn("__chunk", part)
    sizes = marked.groupBy(*keys, "__chunk").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*keys, "__chunk", F.coalesce(before, F.lit(0)).alias("__start"))
    inner = F.row_number().over(Window.partitionBy(*keys, "__chunk").orderBy(order)) - 1
    return marked.withColumn("__inner", inner).join(starts, [*keys, "__chunk"]).withColumn(name, F.col("__start") + F.col("__inner")).drop("__chunk", "__n", "__start", "__inner")


def assign_offsets(df: DataFrame, order: str = "seq", chunk: int = 1_000_000) -> DataFrame:
    return numbered(df, KEYS, order, chunk, "offset").withColumn("offset", F.col("offset").cast("long"))


def partition_detail(log: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """topic, partition, head, tail, size, capacity, fill_pct, evictions: one aggregation, no sort."""
    tail = F.max("offset") + 1
    out = log.groupBy(*KEYS).agg(tail.alias("tail"))
    head = F.greatest(F.col("tail") - capacity, F.lit(0)).cast("long")
    return out.select(*KEYS, head.alias("head"), "tail", (F.col("tail") - head).alias("size"), F.lit(capacity).cast("long").alias("capacity"), ((F.col("tail") - head) / capacity * 100).alias("fill_pct"), head.alias("evictions"))


def retained(log: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The last ``capacity`` rows of each partition."""
    bounds = partition_detail(log, capacity).select(*KEYS, "head")
    return log.join(bounds, list(KEYS)).where(F.col("offset") >= F.col("head")).drop("head")


def store(log: DataFrame, path: str, rows: int = 1_000_000) -> None:
    """Writes a numbered log as Parquet by topic and partition, files of ``rows`` offsets sorted by offset: reads of a range
    then open the directories and row groups that hold it."""
    dealt = log.repartition(*KEYS, F.floor(F.col("offset") / rows))
    dealt.sortWithinPartitions(*KEYS, "offset").write.partitionBy(*KEYS).parquet(path)


def _asked(topic: str, partition: int) -> None:
    if not topic:
        raise ValueError("topic is required")
    if partition < 0:
        raise ValueError("partition must be >= 0")


def fetch(log: DataFrame, topic: str, partition: int, start: int, count: int, capacity: int = CAPACITY) -> DataFrame:
    """Rows of one partition from ``start`` (moved up to the oldest kept) on, ``count`` at most; head and tail beside them.

    A request: it asks for the partition's bounds at once (one aggregation over its offsets), so the page is a range of
    constants over topic, partition and offset, which prunes directories and row groups. An empty topic or a negative
    partition is an error; a partition that isn't there has no rows.
    """
    _asked(topic, partition)
    mine = log.where((F.col("topic") == topic) & (F.col("partition") == partition))
    head, tail = partition_detail(mine, capacity).select("head", "tail").first() or (0, 0)
    first = max(start, head)
    page = mine.where((F.col("offset") >= first) & (F.col("offset") < first + max(count, 0)))
    known = {"head": head, "tail": tail, "next_offset": max(first, min(first + count, tail)), "first_offset": first}
    return page.withColumns({k: F.lit(v).cast("long") for k, v in known.items()})


def rpc_fetch(log: DataFrame, topic: str, partition: int, start: int = 0, max_count: int = 0, capacity: int = CAPACITY) -> DataFrame:
    return fetch(log, topic, partition, start, clamp_count(max_count, 256, 4096), capacity).select("topic", "partition", "offset", "seq", "payload", "head", "tail", "next_offset")


def tcp_fetch(log: DataFrame, topic: str, start: int, max_count: int, capacity: int = CAPACITY) -> DataFrame:
    """Partition 0 only, no timestamps."""
    return fetch(log, topic, 0, start, clamp_count(max_count, 1, 4096), capacity).select("offset", "payload")


def http_fetch(log: DataFrame, topic: str, partition: int = 0, start: int = 0, limit: int | None = None, capacity: int = CAPACITY) -> DataFrame:
    """20 rows where no limit is given, 100 at most."""
    shown = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return fetch(log, topic, partition, start, 20 if limit is None else min(limit, 100), capacity).select("offset", shown.alias("timestamp"), F.col("payload").cast("string").alias("payload"))


def session_is(tenant: str | None = None, project: str | None = None, session: str | None = None) -> Column:
    """Exact equality on the parts that are given; no part given fits everything."""
    out = F.lit(True)
    for name, value in (("tenant", tenant), ("project", project), ("session_id", session)):
        if value:
            out &= F.col(name) == value
    return out


def fetch_filtered(log: DataFrame, topic: str, partition: int, start: int, wanted: Column, max_count: int = 0, scan_limit: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Matching rows within the scan budget, in order, ``max_count`` at most; next_offset follows the last row returned
    where the count was reached, so a later call misses nothing; scanned counts the rows looked at up to there."""
    most, budget = clamp_count(max_count, 256, 4096), clamp_count(scan_limit, 16384, 65536)
    found = fetch(log, topic, partition, start, budget, capacity).where(wanted)
    cut = found.orderBy("offset").limit(most)
    full = F.count("*").over(Window.partitionBy()) >= most
    after = F.max("offset").over(Window.partitionBy()) + 1
    reached = F.when(full, after).otherwise(F.col("next_offset"))
    return cut.select("topic", "partition", "offset", "seq", "head", "tail", reached.alias("next_offset"), (reached - F.col("first_offset")).alias("scanned"))


def batch_ack(df: DataFrame, batch: str) -> DataFrame:
    """First and last offset and number of rows of each published batch."""
    return df.groupBy(batch).agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.count("*").alias("count"))


def topic_stats(detail: DataFrame) -> DataFrame:
    """One row a topic with its partitions nested, as a statistics page shows it."""
    entry = F.struct("partition", "head", "tail", "size", "capacity", "fill_pct", "evictions")
    return detail.groupBy("topic").agg(F.sort_array(F.collect_list(entry)).alias("partitions"), F.sum("size").alias("total"), F.count("*").cast("int").alias("n_partitions"))


def session_replay(log: DataFrame, tenant: str, project: str, session: str, partition: int, topic: str, start: int = 0, max_events: int = 0) -> DataFrame:
    """The flagship read: one session in order, with milliseconds since its first event.

    The caller derives the partition from the session's key; of a stored log only that directory is read.
    """
    _asked(topic, partition)
    mine = log.where((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") >= start) & session_is(tenant, project, session))
    return elapsed(mine.orderBy("offset").limit(max_events) if max_events > 0 else mine)


def elapsed(events: DataFrame) -> DataFrame:
    """Adds elapsed_ms: time since the session's first event in offset order, found by one aggregation, not by sorting sessions."""
    keys = ["tenant", "project", "session_id"]
    first = events.groupBy(*keys).agg(F.min_by(F.unix_micros("ts"), "offset").alias("__first"))
    out = events.join(first, keys).withColumn("elapsed_ms", ((F.unix_micros("ts") - F.col("__first")) / 1000).cast("long"))
    return out.select(*events.columns, "elapsed_ms")


_JSON = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+')


def _refuse(name: str):
    raise ValueError(name)


def indented(text: str, prefix: str = "    ", step: str = "  ") -> str:
    """JSON text over several lines, every token as it was written; other text as it is."""
    try:
        json.loads(text, parse_constant=_refuse, parse_int=str, parse_float=str)
    except (ValueError, RecursionError):
        return text
    out, depth, before = [], 0, ""
    for token in _JSON.findall(text):
        depth -= token in "}]"
        if before and before in "{[" and token in "}]":
            pass
        elif token in "}]" or before and before in "{[,":
            out.append("\n" + prefix + step * depth)
        out.append(token + " " * (token == ":"))
        depth += token in "{["
        before = token
    return "".join(out)


def _indented(payload: pd.Series) -> pd.Series:
    return payload.map(indented, na_action="ignore")


def pretty(event: dict[str, Column]) -> Column:
    """[12:00:00.000] off=7      tool.call      step (attempt 2)  agent=planner

    The event's own time stands in for a missing timestamp. A payload of 1 to 4095 bytes follows on lines of its own.
    """
    tries = F.when(event["attempt"] > 1, F.format_string(" (attempt %d)", event["attempt"])).otherwise("")
    step = F.coalesce(F.concat(F.lit(" "), F.nullif(event["step"], F.lit(""))), F.lit(""))
    at = F.coalesce(event["ts"], event["created_at"]) if "created_at" in event else event["ts"]
    line = F.format_string("[%s] off=%-6d %-14s%s%s  agent=%s", F.date_format(at, "HH:mm:ss.SSS"), event["offset"], event["type"], step, tries, event["agent_id"])
    if "payload" not in event:
        return line
    size = F.coalesce(F.octet_length(event["payload"]), F.lit(0))
    return F.concat(line, F.when((size > 0) & (size < 4096), F.concat(F.lit("\n    "), F.pandas_udf(_indented, "string")(event["payload"]))).otherwise(""))
