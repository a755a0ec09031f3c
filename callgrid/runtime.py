"""Session helpers shared by the whole library: shared folders, staged tables, shipping of worker code."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import sys
import tempfile
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def by_value(module_name: str) -> None:
    """Have functions of a module travel to the workers with the plan, so that workers need no copy of the library."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def per_process(name: str, make):
    """One object of a worker process for all its tasks, such as a memory of encoded words; Spark reuses its workers."""
    held = sys.modules.setdefault("_callgrid_per_process", types.ModuleType("_callgrid_per_process"))
    if not hasattr(held, name):
        setattr(held, name, make())
    return getattr(held, name)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Where it is unset, a session in one process
    (tests, benches) uses a local folder; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"callgrid-shared-{os.getuid()}")
    return found.rstrip("/")


def staged_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    STAGED.append(path)
    return path


#: Staged tables of this process. Results may still be read from them, so they go only when it ends.
STAGED: list[str] = []


@atexit.register
def sweep() -> None:
    """Delete what this process has staged, if its session is still there."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in STAGED:
            remove(spark, path)
    STAGED.clear()


#: Settings of the session while a staged table is written. Spark drops the plan's shuffle files as soon as the write ends,
#: since nothing reads them again, and batches of rows for Python stay small, so that neither side holds many long texts.
STAGING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Actions inside run with ``STAGING``. The session's own settings are back afterwards."""
    before = {k: spark.conf.get(k, None) for k in STAGING}
    for k, v in STAGING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def stage(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends, and a lost executor loses nothing."""
    path = path or staged_path(df.sparkSession, label)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Delete what is staged inside, at the end. For whole jobs, whose results are written before it ends."""
    before = len(STAGED)
    try:
        yield
    finally:
        for path in STAGED[before:]:
            remove(spark, path)
        del STAGED[before:]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later read needs."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def steady_memory(least: int = 1 << 20) -> None:
    """Have this worker process give blocks of ``least`` bytes or more back to the system as soon as they are free. By
    default the C library comes to keep larger ones for itself, and Spark's workers live on from task to task. Tasks that
    make very many large arrays choose a higher bound: fresh pages cost time."""
    import ctypes

    with contextlib.suppress(OSError, AttributeError):  # another C library keeps its own ways
        ctypes.CDLL(None).mallopt(-3, least)  # -3: M_MMAP_THRESHOLD


def trimmed() -> None:
    """Give free memory of this worker process back to the system, at the end of a task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, rows: int = 256, least: int = 1 << 20):
    """The batches in pieces of few rows, so that only a piece is held as Python objects at a time; at the end of the task
    its memory goes back to the system, blocks of ``least`` bytes at once."""
    steady_memory(least)
    try:
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                yield b.slice(lo, rows)
    finally:
        trimmed()


by_value(__name__)
