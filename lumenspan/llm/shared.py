"""What the corpus operators share: tables cut from their lineage, and safe column names."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lumenspan.functions.workers import ship

_written: list[tuple[SparkSession, str]] = []
_kept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="lumenspan-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/lumenspan/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; with ``keep`` it outlives its ``scope``.

    A lost executor then costs a reread of files, not the stages before them.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    if keep:
        _kept.add(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """At its end all tables written within go, but for one to keep; then those kept before go as well.

    So a chain of stages has one result and the tables of one stage on disk at a time.
    """
    before = list(_written)
    yield
    new = _written[len(before) :]
    for entry in [*(x for x in before if x[1] in _kept), *(x for x in new if x[1] not in _kept)]:
        drop(spark, entry[1])
        _kept.discard(entry[1])
        _written.remove(entry)


def drop(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001, PERF203  the session may be gone; the folder is scratch
            return


def fresh(taken: list[str], name: str) -> str:
    """``name``, or ``name`` with underscores added, such that no column of a table has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def place(df: DataFrame, name: str) -> int:
    """Where a column stands; case counts as in the session."""
    return df.columns.index(df.select(name).columns[0]) if name in df.columns else df.columns.index(next(c for c in df.columns if c.lower() == name.lower()))


def arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package on the executors, in batches of a few megabytes.

    Spark takes the size of batches from the session when a plan is run, so larger sizes that the
    session has are lowered to ours; smaller ones stay.
    """
    ship(df.sparkSession)
    for key, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 8 << 20)):
        name = f"spark.sql.execution.arrow.{key}"
        now = int(re.sub(r"\D", "", df.sparkSession.conf.get(name)) or 0)
        if not 0 < now <= most:
            df.sparkSession.conf.set(name, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        tidy()

    return df.mapInArrow(run, schema)


def tidy() -> None:
    """Give memory that a task has used back to the system; Python workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``limit`` bytes of a text or binary column, one row at least."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
