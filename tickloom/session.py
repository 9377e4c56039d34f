"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that change results or failure behaviour; sizing is left to the cluster.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # rows of few keys leave most partitions empty; that must not keep a small side from being broadcast, or all rows of a key meet in one task
    "spark.sql.adaptive.nonEmptyPartitionRatioForBroadcastJoin": "0",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "tickloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_runtime_conf(spark: SparkSession) -> None:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder for checkpoints and written intermediates.

    On a cluster it lies under ``spark.checkpoint.dir``, which every executor can reach. Only
    where that is unset (tests on one machine) is a local temporary folder made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/tickloom/{label}-{uuid.uuid4().hex}"


def materialise(df, label: str):
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage, survives executors."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
