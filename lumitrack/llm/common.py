"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words are runs of anything but these ASCII white-space characters (a fixed value of the query contracts).
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``; where that is unset on one machine, as in tests,
    a temporary one. On a cluster it has to be set."""
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not context.getCheckpointDir():
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df``, a small table, computed once and kept in the shared folder. Spark removes the files once nothing refers to
    them where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on; otherwise they stay."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    """The path and its file system, as Spark sees them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back; removed when the driver ends."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    out = _written(df, path)
    where, files = _at(df.sparkSession, path)
    files.deleteOnExit(where)
    return out


class Scratch:
    """Tables of one operator's run in the shared folder; they are removed when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        where, files = _at(self.spark, self.path)
        files.delete(where, True)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        return _written(df, f"{self.path}/{name}-{uuid.uuid4().hex}")


#: Bytes of an Arrow batch where rows hold whole texts or sets: several copies of a batch are in memory at once.
BATCH_BYTES = 4 << 20


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs run inside exchange batches of about ``most`` bytes with Python; the session's setting comes back after."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _give_back() -> None:
    """Returns to the machine what this process has freed but still holds."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


Batches = Iterator[pa.RecordBatch]


def in_arrow(df: DataFrame, batches: Callable[[Batches], Batches], schema: str | StructType) -> DataFrame:
    """``mapInArrow``, whose workers give back a task's memory at its end: they live on beside later stages."""

    def run(them: Batches) -> Batches:
        yield from batches(them)
        _give_back()

    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def small_enough(df: DataFrame, limit: int) -> bool:
    """Whether ``df`` has at most ``limit`` rows; reads no more than that."""
    return df.limit(limit + 1).count() <= limit


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each of ``names``, with underscores in front until no column of ``df`` has it, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out
