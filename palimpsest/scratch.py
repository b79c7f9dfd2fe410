"""Intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's settings of a write here: an action's shuffle files go when it has ended; batches that go to Python hold 4 MB, where the session names no size.
_CLEANUP, _BATCH = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH = 4 << 20
#: Where each intermediate table lies; the scopes that a thread is in; and what the settings were before the writes that now run.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_SCOPES, _LOCK, _BEFORE = threading.local(), threading.Lock(), {}


def folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, in the one that the cluster shares; in a temporary one only on a local master without any."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="checkpoints")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        sc.setCheckpointDir(root)
    return f"{root}/palimpsest-{sc.applicationId}"


def lasting(spark: SparkSession) -> str:
    """The folder of what outlives `release`: tables that are remembered for a session."""
    return f"{folder(spark)}/lasting"


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables that this thread writes within lie in a folder of their own, which goes at the end; results must be computed by then."""
    names = _SCOPES.__dict__.setdefault("names", [])
    names.append(f"{folder(spark)}/{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _delete(spark, names.pop())


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """The settings of a write, for as long as any write runs; then they are what they were."""
    with _LOCK:
        held = _BEFORE.setdefault(id(spark), [0, {k: spark.conf.get(k, None) for k in (_CLEANUP, _BATCH)}])
        held[0] += 1
        spark.conf.set(_CLEANUP, "true")
        if held[1][_BATCH] is None:
            spark.conf.set(_BATCH, str(BATCH))
    try:
        yield
    finally:
        with _LOCK:
            held[0] -= 1
            if not held[0]:
                del _BEFORE[id(spark)]
                for key, value in held[1].items():
                    spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def shared(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Write df as a table in the folder that the cluster shares, and read it back: what is above needs nothing below it again.

    Shuffle files of the write go when it ends, and so do the tables `done`, which nothing may need from then on. What an
    operator returns may read the last tables it wrote; they stay until their scope ends, or `release`, as checkpoints would.
    """
    spark = df.sparkSession
    names = getattr(_SCOPES, "names", None)
    path = f"{names[-1] if names else folder(spark) + '/tables'}/{uuid.uuid4().hex}"
    with _settings(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    drop(*done)
    return out


def put(df: DataFrame, path: str) -> None:
    """Write df where a caller wants it; shuffle files of the write go when it ends."""
    with _settings(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete intermediate tables that nothing needs any more."""
    for table in tables:
        _delete(table.sparkSession, _PATHS.pop(table))


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables that were written outside of any scope; results that aren't computed yet are lost with them, what is lasting isn't."""
    _delete(spark, f"{folder(spark)}/tables")
