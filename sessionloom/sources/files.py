"""Logs, offset files and snapshots as DataFrames, read through Spark's own file access (any store it knows).

A binary log file is one task: records have no marks to start from in the middle.
"""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.scalar import bucket_of
from sessionloom.operators.log import assign_offsets
from sessionloom.sources import decode, shared

WAL_SCHEMA = "file string, seq long, version int, ts_ns long, topic string, key string, partition int, payload binary"
SHARD_SCHEMA = "shard_id long, offset long, payload binary"
FRAME_SCHEMA = "file string, seq long, op int, topic string, payload binary"


def _decoded(files: DataFrame, rows_of, schema: str) -> DataFrame:
    """One row for each record that rows_of(path, content) yields, in Arrow batches of bounded size."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [part.split() for part in schema.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = []
                for row in rows_of(path, content.as_py()):
                    held.append(row)
                    if len(held) == 4096:
                        yield batch_of(held)
                        held = []
                if held:
                    yield batch_of(held)

    return files.select("path", "content").mapInArrow(run, schema)


def _binary(spark, path: str, pattern: str) -> DataFrame:
    """The files under a path; a path that isn't there has none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def wal(spark, path: str, partial_tail: bool = True) -> DataFrame:
    """Records of write-ahead-log files of versions 1 to 3, in order within a file; a bad record fails the read."""

    def rows(name, content):
        for seq, (version, ts, topic, key, partition, payload) in enumerate(decode.read_wal(content, partial_tail)):
            yield name, seq, version, ts, topic, key, partition, payload

    return _decoded(_binary(spark, path, "*.wal"), rows, WAL_SCHEMA)


def shard_wal(spark, path: str, start: int = 0) -> DataFrame:
    """(shard_id, offset, payload) from ``start`` on of files named shard-N.wal."""

    def rows(name, content):
        shard = int(re.search(r"shard-(\d+)\.wal$", name)[1])
        for offset, payload in decode.read_shard(content, start):
            yield shard, offset, payload

    return _decoded(_binary(spark, path, "shard-*.wal"), rows, SHARD_SCHEMA)


def frames(spark, path: str) -> DataFrame:
    def rows(name, content):
        for seq, (op, topic, payload) in enumerate(decode.read_frames(content)):
            yield name, seq, op, topic, payload

    return _decoded(_binary(spark, path, "*"), rows, FRAME_SCHEMA)


def rebuilt_log(records: DataFrame, partitions: int = 3) -> DataFrame:
    """Write-ahead-log records as a partitioned log: an explicit partition, else the key's, else 0; offsets in file order.

    Times stay those of the records.
    """
    place = F.when(F.col("partition") >= 0, F.col("partition")).when(F.col("key") != "", bucket_of(F.col("key"), partitions)).otherwise(0).cast("int")
    return assign_offsets(records.withColumn("partition", place).withColumn("ts", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000))))


def group_offsets(spark, path: str) -> DataFrame:
    """(topic, grp, partition, committed) of an offsets file, a JSON map of topic::group::pN; none if it isn't there."""
    files = _binary(spark, path, "[!_.]*").select(F.col("content").cast("string").alias("text"))
    pairs = files.select(F.explode(F.from_json("text", "map<string, long>")).alias("k", "committed"))
    part = lambda k: F.regexp_extract("k", r"(?s)^(.*)::(.*)::p(\d+)$", k)
    return pairs.select(part(1).alias("topic"), part(2).alias("grp"), part(3).cast("int").alias("partition"), "committed")


def cluster_snapshot(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, shard leaders, shard count) of a metadata snapshot: typed members, or in the first version a map id -> address."""
    text = _binary(spark, path, "[!_.]*").select(F.col("content").cast("string").alias("t"))
    old, new = "map<string, string>", "map<string, struct<addr: string, client_addr: string>>"
    s = text.select(
        F.coalesce(F.get_json_object("t", "$.version").cast("int"), F.lit(1)).alias("version"), F.get_json_object("t", "$.members").alias("m"),
        F.from_json(F.get_json_object("t", "$.shard_leaders"), "map<string, string>").alias("leaders"), F.coalesce(F.get_json_object("t", "$.shard_count").cast("long"), F.lit(0).cast("long")).alias("shard_count"),
    )
    typed = s.where("version >= 2").select(F.explode(F.from_json("m", new)).alias("node_id", "x")).select("node_id", "x.addr", "x.client_addr")
    plain = s.where("version < 2").select(F.explode(F.from_json("m", old)).alias("node_id", "addr")).select("node_id", "addr", F.lit(None).cast("string").alias("client_addr"))
    return typed.unionByName(plain), s.select(F.explode("leaders").alias("shard_id", "node_id")).withColumn("shard_id", F.col("shard_id").cast("long")), s.select("shard_count")


def write_wal(df: DataFrame, path: str) -> None:
    """Rows (ts_ns, topic, key, partition, payload) as checked records, one file a task, in a folder that tasks share."""

    def run(batches):
        n = 0

        def records():
            nonlocal n
            for batch in batches:
                for r in batch.to_pylist():
                    n += 1
                    yield decode.wal_record(r["ts_ns"], r["topic"], r["key"] or "", r["partition"], bytes(r["payload"]))

        shared.put(path, f"part-{TaskContext.get().partitionId():06d}.wal", records())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    df.select("ts_ns", "topic", "key", "partition", F.col("payload").cast("binary")).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def write_shard_wal(df: DataFrame, path: str) -> None:
    """Rows (shard_id, seq, payload) as one file a shard, records in order of seq: the format keeps a shard's log in one file."""

    def run(batches):
        rows = ((s, p) for batch in batches for s, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for shard, mine in itertools.groupby(rows, key=lambda r: r[0]):
            shared.put(path, f"shard-{shard}.wal", (decode.shard_record(bytes(p)) for _, p in mine))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64())], names=["n"])

    ordered = df.repartition("shard_id").sortWithinPartitions("shard_id", "seq").select(F.col("shard_id").cast("long"), F.col("payload").cast("binary"))
    ordered.mapInArrow(run, "n long").agg(F.count("*")).collect()


def write_group_offsets(commits: DataFrame, path: str) -> None:
    """(topic, grp, partition, committed) as an offsets file: one JSON map, as small as the number of groups and partitions."""
    key = F.concat_ws("::", "topic", "grp", F.concat(F.lit("p"), "partition"))
    commits.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, F.col("committed").cast("long"))))).alias("value")).write.text(path)
