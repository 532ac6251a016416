"""The folder that driver and executors share, and tables kept in it for as long as the session runs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder of spark.checkpoint.dir. A local session that names none gets a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sessionloom-"))
    return context.getCheckpointDir()


def fresh_path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def store_of(path: str):
    """(file system, path in it) for tasks; a path without a scheme is a mounted folder."""
    return fs.FileSystem.from_uri(path) if re.match(r"^\w+:/", path) else (fs.LocalFileSystem(), path)


def put(path: str, name: str, parts) -> None:
    """A file made of byte strings, complete or absent: a repeated task puts the same bytes under the same name."""
    where, root = store_of(path)
    where.create_dir(root, recursive=True)
    passing = f"{root}/.{uuid.uuid4().hex}"
    with where.open_output_stream(passing) as out:
        for part in parts:
            out.write(part)
    where.move(passing, f"{root}/{name}")


_kept: dict[tuple, str] = {}


def _status(spark, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop)


def changed_at(spark, path: str) -> int:
    """When a file or folder last changed."""
    return _status(spark, path).getModificationTime()


def is_folder(spark, path: str) -> bool:
    return _status(spark, path).isDirectory()


def kept(spark, name: str, source: str, write: Callable[[str], None], schema) -> DataFrame:
    """A table derived from ``source``, written once a session by ``write(path)`` and again when the source has changed."""
    key = (spark.sparkContext.applicationId, name, source, changed_at(spark, source))
    if key not in _kept:
        path = fresh_path(spark, name)
        write(path)
        _kept[key] = path
    return spark.read.schema(schema).parquet(_kept[key])
