"""What the training-data operators share: text buffers, the shared folder, shipping of this package."""

from __future__ import annotations

import atexit
import ctypes
import functools
import itertools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER_AZ = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

#: Bytes of one Arrow batch, about; a single row may be larger.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Cuts from one collection of what nothing refers to any more to the next.
COLLECT = 8
_cuts = itertools.count(1)

#: Bytes from which a buffer is returned to the system when it is freed.
LARGE = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offsets(column: pa.Array) -> np.ndarray:
    """n + 1 offsets of the values of a string or binary column, from 0."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return offs - offs[0] if len(offs) else np.zeros(1, np.int64)


def raw_text(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """All texts as one bytes object and n + 1 offsets into it; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    start = int(offs[0]) if len(offs) else 0
    stop = int(offs[-1]) if len(offs) else 0
    return (data[start:stop].to_pybytes() if data is not None else b""), offs.astype(np.int64) - start


@functools.cache
def _returning() -> Callable[[int], object]:
    """From now on this process gives large buffers back as soon as they are free, Arrow's too; what gives back the rest."""
    libc = ctypes.CDLL(None)
    if not hasattr(libc, "mallopt") or not hasattr(libc, "malloc_trim"):  # not glibc
        return lambda keep: pa.default_memory_pool().release_unused()
    libc.mallopt(-3, LARGE)  # M_MMAP_THRESHOLD; once set it doesn't rise any more
    libc.mallopt(-1, LARGE)  # M_TRIM_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())
    return libc.malloc_trim


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over a worker's batches, holding no free memory.

    A Python worker outlives its task and serves those of later stages. Both allocators, the C library's and Arrow's, keep
    freed buffers, each for itself, so that a worker would come to hold the sum of what its stages needed.
    """

    @functools.wraps(run)
    def held(batches: Iterator) -> Iterator:
        give_back = _returning()
        try:
            yield from run(batches)
        finally:
            give_back(0)

    return held


def is_local(spark: SparkSession) -> bool:
    """True if driver and executors are one process, so that they share local folders."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="framealign-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later steps read its files, and Spark removes them with the last reference.

    Spark removes shuffles and checkpoints when the driver's collector finds that nothing refers to them, which may take
    long where little else is collected; so the collector is asked for at every COLLECT-th cut.
    """
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    if next(_cuts) % COLLECT == 0:
        spark.sparkContext._jvm.System.gc()
    return out


_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, what: str) -> str:
    """A new place below the shared folder; removed at exit."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def staged(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """`df` as a Parquet table in the shared folder, for larger intermediates; removed at exit."""
    spark = df.sparkSession
    path = folder(spark, what)
    df.write.option("parquet.enable.dictionary", "false").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(path: str, spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                drop_staged(path, spark)
        except Exception:  # the session may have ended first
            return


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, unless their Python path has it already; bound the batches that Python gets."""
    if int(spark.conf.get(_BATCH).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    root = Path(__file__).resolve().parents[2]
    paths = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(root) in paths or (is_local(spark) and Path.cwd() == root):
        return
    sc = spark.sparkContext
    if getattr(sc, "_framealign_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="framealign-")) / "framealign_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "framealign").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))
    sc._framealign_shipped = True
