"""Tables that several jobs of one plan use, kept in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``; where that is unset on one machine, a temporary folder. On a cluster it has to be set."""
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not context.getCheckpointDir():
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return named or context.getCheckpointDir()


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into the shared folder once and read back; removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that may go to every task.
SMALL_ROWS = 20_000


def beside(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A stored table of a row a group, say, to join large ones with: sent to every task where it has no more than ``most``
    rows, so that a large group isn't brought together; a plain join beyond."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
