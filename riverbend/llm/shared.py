"""Places and tables that the driver and all executors share."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROWS_PER_BATCH, _BYTES_PER_BATCH = 512, 2 << 20
#: Bytes of a row group in intermediate tables, which a writing task holds in memory.
_ROW_GROUP = 16 << 20
_owned: list[str] = []


def _cleanup() -> None:
    for path in _owned:
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_cleanup)


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a temp folder only where it is unset and the driver runs all tasks."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        if "://" not in root:  # a plain path is in Spark's default file system, whose name readers in Python need too
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
            root = "file://" + root[len("file:"):] if root.startswith("file:/") and not root.startswith("file://") else root
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: executors and the driver need a folder that all of them see")
    fallback = getattr(shared_root, "fallback", None)
    if fallback is None:
        fallback = "file://" + tempfile.mkdtemp(prefix="riverbend-")
        shared_root.fallback = fallback
        _owned.append(fallback[len("file://"):])
    return fallback


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh shared folder's URI (``clear`` removes it; a local one goes when the driver's Python ends)."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    if path.startswith("file://"):
        os.makedirs(path[len("file://"):], exist_ok=True)
        _owned.append(path[len("file://"):])
    else:
        _stored.append(path)
    return path


_stored: list[str] = []


def clear(spark: SparkSession) -> None:
    """Removes all folders made so far, in any store that Spark writes to: once the results that read them are written elsewhere."""
    for path in _stored + ["file://" + x for x in _owned]:
        _delete(spark, path)
    fallback = getattr(shared_root, "fallback", "")
    _stored.clear()
    _owned[:] = [x for x in _owned if "file://" + x == fallback]


def materialise(df: DataFrame, label: str, waves: int | None = None, keep: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives lost executors.

    With waves, it is written by at most that many tasks for each core of the cluster: for tables that are small beside the corpus.
    Within ``temporary`` the table goes at its end; with keep, at the end of the one around it, if there is one.
    """
    spark = df.sparkSession
    path = f"{new_folder(spark, label)}/table"
    (df if waves is None else df.coalesce(waves * max(spark.sparkContext.defaultParallelism, 2))).write.option("parquet.block.size", _ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[id(out)] = (weakref.ref(out), path)
    scopes = _scopes.get()[:-1] if keep else _scopes.get()
    if scopes:
        scopes[-1].append(path)
    return out


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables materialised within are removed at the end, when what they were needed for is written."""
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in made:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_places: dict[int, tuple[weakref.ref, str]] = {}


def discard(made: DataFrame) -> None:
    """Removes the table of a frame that materialise returned, once nothing reads it any more."""
    ref, path = _places.pop(id(made), (lambda: None, ""))
    if ref() is made:
        _delete(made.sparkSession, path)


_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 10_000, "spark.sql.execution.arrow.maxBytesPerBatch": 64 << 20}


def small_batches(spark: SparkSession, rows: int = _ROWS_PER_BATCH, size: int = _BYTES_PER_BATCH) -> None:
    """Bounds the rows and bytes of one Arrow batch, since whole texts can be long: for frames that are run later. The session's limits are only lowered."""
    for (key, usual), most in zip(_LIMITS.items(), (rows, size), strict=True):
        now = spark.conf.get(key, str(usual))
        if now.startswith("-") or not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) <= most:
            spark.conf.set(key, str(most))


@contextmanager
def batches(spark: SparkSession, rows: int = _ROWS_PER_BATCH, size: int = _BYTES_PER_BATCH) -> Iterator[None]:
    """Bounds Arrow batches for what is run within; the session's limits come back after it."""
    before = {key: spark.conf.get(key, None) for key in _LIMITS}
    for key, most in zip(_LIMITS, (rows, size), strict=True):
        spark.conf.set(key, str(most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def lean(run: Callable) -> Callable:
    """run for mapInArrow; its worker, which Spark keeps for later tasks, gives memory back to the system when a task ends."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def release() -> None:
    """Gives free memory back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def filesystem(uri: str):
    """(pyarrow filesystem, path in it) of a folder or file URI."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_atomically(uri: str, data) -> None:
    """Writes bytes, or an iterator of bytes, under a temporary name and renames: a retried task leaves one whole file."""
    store, path = filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part, compression=None) as out:
        for piece in [data] if isinstance(data, (bytes, memoryview)) else data:
            out.write(piece)
    store.move(part, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns(schema: T.StructType, *extra: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField(n, t, True) for n, t in extra])


def bounded_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """About the n rows of smallest hash of key, at least n where there are; what tasks keep for it does not grow with the table.

    A model's fit may use it; key should tell rows apart. The rows come unordered, and n is exceeded by a half at most on average.
    """
    total = df.count()
    if total <= n:
        return df
    share = min(1.0, 1.25 * n / total + 20 / total)
    return df.where(F.shiftrightunsigned(F.xxhash64(key, F.lit("sample")), 11) < F.lit(int(share * 2.0 ** 53)))
