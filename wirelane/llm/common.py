"""What the operators of this package share: scratch tables, ids, and small expressions."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Bytes of a batch that Spark hands to a Python worker, where the session does not say. Spark's default bounds the rows alone, whatever they hold.
BATCH_BYTES = 4 << 20

_own_folder: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset a temporary folder stands in, but only for a local master: on a cluster no
    machine's own folder is seen by the others, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="wirelane-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return _own_folder[0]


_runs: list[Scratch] = []


@atexit.register
def clean_up() -> None:
    """Delete what all runs of this driver have left: no DataFrame that they returned can be read any more. Called at its exit too."""
    while _runs:
        with contextlib.suppress(Exception):  # the session may have ended before
            _runs.pop().clear()


class Scratch:
    """Tables of one run of an operator, written as Parquet in the shared folder.

    A written table cuts the lineage: after an executor is lost, what it had computed is read
    again instead of being computed anew. Superseded tables are dropped as the run goes on, the rest when
    the driver ends or by clean_up(), as the DataFrame that a run returns reads them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        _runs.append(self)

    def clear(self) -> None:
        self._delete(self.base)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(self.path(name))
        return self.read(df, name)

    def read(self, like: DataFrame, name: str) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no unevaluated DataFrame reads any more."""
        for name in names:
            self._delete(self.path(name))


def slices(batch: pa.RecordBatch, column: str, rows: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of so many rows and bytes of a text column at most; a longer text is a part by itself."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, end - at)
        at = end


def bound_batches(spark: SparkSession) -> None:
    """Let batches to and from Python hold about BATCH_BYTES, unless the session names another size. It holds from then on, as frames run later than they are made."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, spark.conf.get(name, str(BATCH_BYTES)))


def ascii_lower(text: Column) -> Column:
    """A-Z lowered and nothing else. lower() does just that where all characters are ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def int_array(values: list[int], kind: str = "bigint") -> Column:
    """A constant array, as one literal however long it is."""
    if not values:
        return F.expr(f"cast(array() as array<{kind}>)")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A function that gives the value on any executor; objects of this package's classes travel with their classes."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    held: list = []

    def get() -> Any:
        if not held:
            held.append(cloudpickle.loads(sent.value))
        return held[0]

    return get


def worker_store() -> dict:
    """A dictionary that a Python worker keeps from task to task, for caches and loaded files."""
    import sys
    import types

    return sys.modules.setdefault("_wirelane_worker", types.ModuleType("_wirelane_worker")).__dict__


def worker_cache(key: Any, make: Callable[[], Any]) -> Any:
    """What make() gave for a key, kept by a Python worker from task to task. One key is kept at a time: words of an operator do not outlast it."""
    store = worker_store()
    if key not in store.get("cache", {}):
        store["cache"] = {}
        store["cache"][key] = make()
    return store["cache"][key]


def give_back() -> None:
    """Return memory to the system that a worker's allocators hold free: it would stay with the worker, which outlives its tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # of the GNU C library alone
        ctypes.CDLL(None).malloc_trim(0)


def tidy(batches: Iterator[pa.RecordBatch], key: Any = None) -> Iterator[pa.RecordBatch]:
    """The batches; frees what worker_cache() keeps under another key and unused memory before them, and unused memory after each."""
    if key not in (store := worker_store()).get("cache", {}):
        store.pop("cache", None)
    give_back()
    for batch in batches:
        yield batch
        del batch
        give_back()
