"""Tables, the shared folder, and what all operators of this package need from a session."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (local runs)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="cadence-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: While a table is written: its shuffle files go with the end of the writing, so that a chain of tables needs the
#: disk of one link at a time; and Arrow batches are small, so that whole texts don't fill the memory beside the heap.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores before it as far as a column has that name already."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back, which cuts the lineage there; ``options`` are those of the Parquet writer."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.options(**options).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table of keep() that no plan reads any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def joinable(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """For a join's side of narrow rows: broadcast up to ``rows`` of them, counted first; merged beyond."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lowers the session's Arrow batches to rows of long texts, unless they have been set to something of their own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def give_back(collect: bool = True) -> None:
    """Returns what a Python process has freed to the machine; ``collect`` looks for rings of objects first, which takes a while."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def returning_memory(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, before and after which the worker gives its free memory back: it stays alive between tasks beside the executor's heap, and what it held for another stage is let go as a task begins."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def byte_slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts hold about ``limit`` bytes each; a longer text is a run of its own."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def byte_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int, most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Deals a task's rows anew into blocks of about ``limit`` bytes of text and ``most`` rows, wherever the batches end."""
    held: list[pa.RecordBatch] = []
    size = rows = 0

    def block() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        start = 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).fill_null(0).to_pylist()):
            if rows and (size + n > limit or rows == most):
                held.append(batch.slice(start, i - start))
                yield block()
                held, start, size, rows = [], i, 0, 0
            size += n
            rows += 1
        held.append(batch.slice(start))
    if rows:
        yield block()
