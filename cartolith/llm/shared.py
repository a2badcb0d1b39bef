"""Shared storage: cutting lineage through tables every executor can read."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset (local runs, tests) a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="cartolith-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later jobs, and tasks retried after a lost
    executor, start from the files and not from the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialised = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._materialised)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the cluster sizes this to its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bound_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches of at most about size bytes between the JVM and Python (a single longer row still goes whole), so that a batch of
    long texts doesn't decide a worker's memory. A smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or int(now) <= 0 or int(now) > size:
        spark.conf.set(name, str(size))


def worker_cache(name: str, key: str, make: Callable[[], object]) -> object:
    """make(), kept in the worker from task to task. A worker holds one such object: another name or key takes its place."""
    kept = sys.__dict__.setdefault("_corpus_cache", {})
    if (name, key) not in kept:
        kept.clear()
        give_back()
        kept[name, key] = make()
    return kept[name, key]


def give_back() -> None:
    """Return free memory of this process to the system: Python and Arrow keep it otherwise, for as long as Spark keeps the worker."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(f: Callable) -> Callable:
    """f, for mapInArrow, in a worker without another operator's cache; memory goes back at the task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.__dict__.setdefault("_corpus_cache", {}).clear()
        give_back()
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def lean_group(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for applyInArrow: memory goes back after each group."""

    def run(table: pa.Table) -> pa.Table:
        sys.__dict__.setdefault("_corpus_cache", {}).clear()
        try:
            return f(table)
        finally:
            give_back()

    return run
