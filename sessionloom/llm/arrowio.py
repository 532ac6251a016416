"""Small helpers shared by the operators that run in Python workers over Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.sources.shared import shared_folder

#: Bytes of text that one call of a vectorised kernel gets at once; a single longer text still goes whole.
CHUNK_BYTES = 1 << 20
#: Bytes of one Arrow batch between the JVM and Python: each side holds a whole batch, and several while it is copied.
BATCH_BYTES = 4 << 20


def small_batches(spark) -> None:
    """Bounds this session's Arrow batches by bytes, as a batch of many long texts is large whatever its number of rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) != str(BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_residents: list[tuple[str, Callable]] = []


def resident(f: Callable) -> Callable:
    """Remembers results of ``f``, which are large and slow to make, until the worker gets a task of another module than f's."""
    cached = functools.lru_cache(2)(f)
    _residents.append((f.__module__, cached))
    return cached


def make_room(module: str) -> None:
    """Drops the residents of other modules: a worker outlives its operator, and would hold them beside the next one's arrays."""
    others = [cached for owner, cached in _residents if owner != module and cached.cache_info().currsize]
    for cached in others:
        cached.cache_clear()
    if others:
        gc.collect()
        release()


def lean(f: Callable, module: str = "") -> Callable:
    """``f`` over a task's batches; its worker, which outlives the task, then gives back what it no longer uses.

    module: whose residents the task may use, if not those of f's own.
    """
    module = module or f.__module__

    @functools.wraps(f)
    def run(batches):
        make_room(module)
        try:
            yield from f(batches)
        finally:
            release()

    return run


def documents(spark, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; other columns never reach Python."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes | None]]]:
    """(ids, texts as UTF-8 bytes or None) in runs of about ``limit`` bytes."""
    ids: list = []
    texts: list[bytes | None] = []
    held = 0
    for batch in batches:
        column = batch.column(1).cast(pa.large_binary())
        for key, value in zip(batch.column(0).to_pylist(), column, strict=True):
            text = value.as_py()
            ids.append(key)
            texts.append(text)
            held += len(text) if text else 1
            if held >= limit:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def map_chunks(df: DataFrame, kernel: Callable, schema: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow over (doc_id, text) rows; ``kernel(ids, texts)`` returns columns of ``schema`` in order, or None."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches):
        for ids, texts in chunks(batches, limit):
            columns = kernel(ids, texts)
            if columns is not None:
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    return df.mapInArrow(lean(run, kernel.__module__), schema)


@contextlib.contextmanager
def no_shuffles_kept(spark):
    """What runs inside has its shuffle files removed when it ends: staged rows are read from their files from then on."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stage(df: DataFrame, *by: str) -> DataFrame:
    """The rows written once as Parquet to the shared folder and read again: short lineage, and lost executors cost nothing.

    by: columns by whose values the files are kept apart.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    with no_shuffles_kept(spark):
        df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def stage_bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """As ``stage``, in buckets by a column: later joins on it read the rows where they lie, without a shuffle."""
    spark = df.sparkSession
    small_batches(spark)
    name = f"stage_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    with no_shuffles_kept(spark):
        df.write.bucketBy(buckets, column).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._stage_path, out._stage_table = path, name
    return out


def drop_stage(staged: DataFrame, part: str = "") -> None:
    """Deletes a staged table that no later step reads, or the files of one value (``column=value``) of it."""
    spark = staged.sparkSession
    if hasattr(staged, "_stage_table"):
        spark.sql(f"drop table if exists {staged._stage_table}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{staged._stage_path}/{part}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
