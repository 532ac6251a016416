"""The logs as Python data sources: spark.read.format("wal") / "shardwal", and shardwal as a stream.

Files are reached by pyarrow's file systems, a path without a scheme being a mounted folder.
"""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, DataSourceStreamReader

from sessionloom.sources import decode
from sessionloom.sources.files import SHARD_SCHEMA, WAL_SCHEMA
from sessionloom.sources.shared import store_of


def _files(path: str) -> list[str]:
    store, root = store_of(path)
    found = store.get_file_info(root)
    if found.type == fs.FileType.NotFound:
        return []
    infos = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(i.path for i in infos if i.type == fs.FileType.File and i.path.endswith(".wal"))


def _content(path: str, name: str) -> bytes:
    with store_of(path)[0].open_input_file(name) as f:
        return f.read()


class FilePartition(InputPartition):
    pass


class WalReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.lenient = options["path"], options.get("partial_tail", "true") == "true"
        self.topic = None

    def pushFilters(self, filters):
        """topic = ... is applied while decoding; everything is still checked by Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("topic",):
                self.topic = f.value
            yield f

    def partitions(self):
        return [FilePartition(name) for name in _files(self.path)]

    def read(self, partition):
        for seq, (version, ts, topic, key, number, payload) in enumerate(decode.read_wal(_content(self.path, partition.value), self.lenient)):
            if self.topic is None or topic == self.topic:
                yield partition.value, seq, version, ts, topic, key, number, payload


class WalDataSource(DataSource):
    @classmethod
    def name(cls):
        return "wal"

    def schema(self):
        return WAL_SCHEMA

    def reader(self, schema):
        return WalReader(self.options)


def _shard(name: str) -> int:
    return int(re.search(r"shard-(\d+)\.wal$", name)[1])


class ShardReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.start = options["path"], int(options.get("from", 0))

    def partitions(self):
        return [FilePartition(name) for name in _files(self.path) if re.search(r"shard-\d+\.wal$", name)]

    def read(self, partition):
        for offset, payload in decode.read_shard(_content(self.path, partition.value), self.start):
            yield _shard(partition.value), offset, payload


class ShardRange(InputPartition):
    def __init__(self, name: str, offset: int, begin: int, end: int):
        self.name, self.offset, self.begin, self.end = name, offset, begin, end


class ShardStream(DataSourceStreamReader):
    """A stream's offset is, for each shard, how many records were seen and where the next one begins.

    The driver reads sizes of records only, from where it was; tasks read the records between two offsets, a shard each.
    """

    def __init__(self, options):
        self.path, self.start, self.seen = options["path"], int(options.get("from", 0)), {}

    def initialOffset(self):
        return {}

    def _shards(self) -> dict[str, str]:
        return {str(_shard(name)): name for name in _files(self.path) if re.search(r"shard-\d+\.wal$", name)}

    def latestOffset(self):
        store, _ = store_of(self.path)
        for key, name in self._shards().items():
            count, at = self.seen.get(key, (0, 0))
            with store.open_input_file(name) as f:
                size = f.size()
                while at + 8 <= size:
                    f.seek(at)
                    n = decode.shard_size(f.read(4))
                    if at + 8 + n > size:
                        break
                    count, at = count + 1, at + 8 + n
            self.seen[key] = (count, at)
        return {k: list(v) for k, v in self.seen.items()}

    def partitions(self, start, end):
        names, out = self._shards(), []
        for key, (count, to) in end.items():
            first, begin = start.get(key, (0, 0))
            if count > first:
                out.append(ShardRange(names[key], first, begin, to))
        return out

    def read(self, partition):
        with store_of(self.path)[0].open_input_file(partition.name) as f:
            f.seek(partition.begin)
            data = f.read(partition.end - partition.begin)
        for offset, payload in decode.read_shard(data):
            if partition.offset + offset >= self.start:
                yield _shard(partition.name), partition.offset + offset, payload

    def commit(self, end):
        pass


class ShardWalDataSource(DataSource):
    @classmethod
    def name(cls):
        return "shardwal"

    def schema(self):
        return SHARD_SCHEMA

    def reader(self, schema):
        return ShardReader(self.options)

    def streamReader(self, schema):
        return ShardStream(self.options)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WalDataSource)
    spark.dataSource.register(ShardWalDataSource)
