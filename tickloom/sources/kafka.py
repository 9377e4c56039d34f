"""Kafka tick source and topic sinks. They need the Kafka package on the cluster's class path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: topic names; each has a retry and a dead-letter topic
TOPICS = ("ticks", "bars", "signals", "orders", "fills")


def read_topic(spark: SparkSession, servers: str, topic: str, *, max_offsets: int = 1_000_000) -> DataFrame:
    """Committed records from the earliest offset, with headers as a map and a default event id."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
           .option("startingOffsets", "earliest").option("kafka.isolation.level", "read_committed").option("includeHeaders", "true")
           .option("maxOffsetsPerTrigger", max_offsets).load())
    heads = F.map_from_entries(F.transform("headers", lambda h: F.struct(h["key"], h["value"].cast("string"))))
    return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), heads.alias("headers"),
                      F.concat_ws(":", "topic", "partition", "offset").alias("event_id"), "topic", "partition", "offset", "timestamp")


def envelope(df: DataFrame, *, key: str = "symbol", headers: Sequence[str] = (), payload: Sequence[str] | None = None) -> DataFrame:
    """(key, value, headers) to publish: the ``payload`` columns as JSON (default: all), keyed by ``key``, with the ``headers`` columns as strings; a NULL one is left out."""
    told = F.filter(F.array(*[F.struct(F.lit(h).alias("key"), F.encode(F.col(h).cast("string"), "utf-8").alias("value")) for h in headers]), lambda h: h["value"].isNotNull()) if headers else None
    body = F.to_json(F.struct(*(payload or df.columns)))
    return df.select(F.col(key).cast("string").alias("key"), body.alias("value"), *([told.alias("headers")] if headers else []))


def write_topic(df: DataFrame, servers: str, topic: str, checkpoint: str, *, key: str = "symbol", headers: Sequence[str] = (), suffix: str = ""):
    """Rows as JSON keyed by symbol, with headers; ``suffix`` is ``.retry`` or ``.dlq`` for failing rows."""
    return (envelope(df, key=key, headers=headers).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic + suffix).option("includeHeaders", str(bool(headers)).lower())
            .option("checkpointLocation", checkpoint).start())
