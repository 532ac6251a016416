"""Structured Streaming forms: ingest with stateful offsets, session tail, consumer groups, webhook delivery."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sessionloom.functions.scalar import bucket_of, session_key
from sessionloom.operators.log import session_is


def with_partition(events: DataFrame, partitions: int = 3) -> DataFrame:
    """The routing columns of incoming events; the same function serves batch and stream."""
    keyed = events.withColumn("key", session_key(F.col("tenant"), F.col("project"), F.col("session_id")))
    return keyed.withColumn("partition", bucket_of(F.col("key"), partitions))


def assign_offsets(stream: DataFrame, order: str = "seq") -> DataFrame:
    """Adds offset: the next number of the row's (topic, partition), kept as state from batch to batch.

    Rows of a batch are numbered in order of ``order``; one partition is one group, as the log's order is its own.
    """
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, offset long"

    def number(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        (tail,) = state.get if state.exists else (0,)
        rows["offset"] = range(tail, tail + len(rows))
        state.update((tail + len(rows),))
        yield rows

    return stream.groupBy("topic", "partition").applyInPandasWithState(number, schema, "tail long", "append", GroupStateTimeout.NoTimeout)


def tail_session(stream: DataFrame, tenant: str, project: str, session: str) -> DataFrame:
    """A live stream of one session's events."""
    return stream.where(session_is(tenant, project, session))


def consume(stream: DataFrame, group: str, handle: Callable[[DataFrame], None], commit: Callable[[DataFrame], None]):
    """A writer that hands each batch over and only then commits (topic, grp, partition, committed = last offset + 1).

    After a failure between the two a batch is handed over again: at least once.
    """

    def each(batch: DataFrame, _: int) -> None:
        handle(batch)
        commit(batch.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("committed")).select("topic", F.lit(group).alias("grp"), "partition", "committed"))

    return stream.writeStream.foreachBatch(each)


def event_rates(stream: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Extension: event-time counts by topic and type; rows later than the watermark are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "topic", "type").agg(F.count("*").alias("n"))


def http_post(url: str, body: bytes, headers: dict[str, str], timeout: float = 10.0) -> int:
    """Status of a POST; 599 where no answer came."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as answer:
            return answer.status
    except urllib.error.HTTPError as e:
        return e.code
    except OSError:
        return 599


def deliver_row(row: dict, url: str, headers: dict[str, str], post=http_post, most: int = 5, first_s: float = 0.5, sleep=time.sleep) -> tuple[str, int]:
    """(outcome, tries) of one message: 2xx is done; 4xx but 408 and 429 drops it; others are tried again, waiting twice as long each time, 30 s at most."""
    sent = {**headers, "Content-Type": "application/json", "X-Partition": str(row["partition"]), "X-Offset": str(row["offset"])}
    body = row["payload"] if isinstance(row["payload"], bytes) else (row["payload"] or "").encode()
    most = max(most, 1)
    for attempt in range(1, most + 1):
        status = post(url, body, sent)
        if 200 <= status < 300:
            return "done", attempt
        if 400 <= status < 500 and status not in (408, 429):
            return "drop", attempt
        if attempt < most:
            sleep(min(30.0, first_s * 2 ** (attempt - 1)))
    return "drop", most


def webhook(stream: DataFrame, url: str, headers: dict[str, str] | None = None, deliver: Callable = deliver_row):
    """A writer that posts every row from the executors, partition by partition in order; receivers tell repeats by (partition, offset)."""
    headers = headers or {}

    def each(batch: DataFrame, _: int) -> None:
        def send(rows) -> None:
            for row in rows:
                deliver(row.asDict(), url, headers)

        batch.repartition("topic", "partition").sortWithinPartitions("topic", "partition", "offset").foreachPartition(send)

    return stream.writeStream.foreachBatch(each)


def jsonl(row: dict) -> str:
    return json.dumps(row, default=str, separators=(",", ":"))
