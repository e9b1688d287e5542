"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import logging
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches hold at most so many rows and bytes; a batch always holds one row at least.
BATCH_ROWS = 2048
BATCH_BYTES = 24 << 20
_LOG = logging.getLogger(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir`` (any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session, so that very long texts cannot fill a Python worker.

    This lowers two settings of the caller's session and leaves them so: plans are lazy, and read them when they run.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        try:
            now = int(spark.conf.get(name))
        except Exception:  # the setting is unknown to this release, or has a unit
            now = 0
        if not 0 < now <= most:
            spark.conf.set(name, str(most))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session or its context.

    Where it is unset, a local[...] session gets a folder of its own, for
    there all tasks are this process; on a cluster that would lose rows, so it
    is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='columnade-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(session, path: str) -> None:
    if session.sparkContext._jsc is None:  # the session has ended: the folder's owner clears it
        return
    try:
        where = session.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except (Py4JError, OSError) as e:  # tidying up fails no query, but a store that fills up should be seen
        _LOG.warning("%s was not deleted: %s", path, e)


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: what follows survives the loss of any executor, and
    several readers see the same rows. The files stay until :func:`discard`
    or the end of the program.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/columnade/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    made = spark.read.schema(df.schema).parquet(path)
    made._columnade_path = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`written` that no plan needs any more."""
    for df in tables:
        path = df.__dict__.get("_columnade_path")
        if path:
            _remove(df.sparkSession, path)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` under the batch bounds of :func:`tune`; a task gives back what memory it no longer needs."""
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _settle_allocator()
        for owner in [m for m in _kept if m != fn.__module__]:
            _kept.pop(owner)()
        try:
            yield from fn(batches)
        finally:
            _trim()

    return df.mapInArrow(run, schema)


#: What clears the memory that an operator's module keeps in this Python worker from task to task.
_kept: dict[str, Callable[[], None]] = {}


def keeps(module: str, clear: Callable[[], None]) -> None:
    """Say that ``module`` keeps something between tasks; ``clear`` is called when another module's task starts in this worker."""
    _kept[module] = clear


def _glibc(name: str):
    return getattr(ctypes.CDLL(None), name, None) if sys.platform == "linux" else None


@functools.cache
def _settle_allocator() -> None:
    """Arrays of 4 MB or more are given back as soon as they are freed, where the C library is glibc (M_MMAP_THRESHOLD, M_TRIM_THRESHOLD)."""
    if set_option := _glibc("mallopt"):
        set_option(-3, 4 << 20)
        set_option(-1, 8 << 20)


def _trim() -> None:
    """Free memory goes back to the system: Python workers live on after a task, and the next one may be another operator's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := _glibc("malloc_trim"):
        trim(0)


def fold(doc_id: str, modulus: int):
    """``crc32(doc_id as text) mod modulus``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows of a table whose keys are different, chosen by a hash of the key alone, so the same at every layout.

    First go those whose hash lies above a share that leaves about four times
    as many, so that what is ordered does not grow with the table.
    """
    share = min(1.0, (4.0 * rows + 100) / max(1, df.count()))
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 40)) / float(1 << 40)
    return (df if share == 1.0 else df.where(part < share)).orderBy(part, F.col(key)).limit(rows)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
