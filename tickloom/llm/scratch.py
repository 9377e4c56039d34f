"""Written intermediates in the shared folder, and joins whose small side is broadcast only when its size is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import scratch_dir

BATCH_BYTES = 8 << 20
BROADCAST_ROWS = 500_000  # rows of one or two numbers; beyond, the join shuffles


def bounded_batches(spark: SparkSession) -> None:
    """Let batches of rows that go to Python workers hold at most about ``BATCH_BYTES`` from now on: by default they may hold 64 MB, several times over in the JVM and in the worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``rows`` rows. It is counted, so it should be a written one."""
    return F.broadcast(df) if df.count() <= rows else df
