"""Consuming a partitioned topic once: offsets committed with the rows, gaps and replays told, failing messages retried and then set aside.

A micro-batch writes its rows and the offsets it has reached under its own id, and reads those of the batch before it. A replayed batch overwrites its own folders, so rows and offsets never disagree. Messages
have ``topic``, ``partition``, ``offset``, ``key``, ``value`` and ``headers`` (a map of strings), as ``sources.kafka.read_topic`` or a folder of files gives them. Tables under ``base``:

* ``rows``: new messages by ``route`` - ``good``, ``retry`` (its ``retry-attempt`` header raised) or ``dead`` (attempts used up);
* ``offsets``: (topic, partition, expected, taken, replayed) after the batch, ``expected`` being the next offset;
* ``gaps``: (topic, partition, expected, observed) wherever offsets were skipped.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from tickloom.functions.exprs import join_back

PARTITION = ["topic", "partition"]
ATTEMPT = "retry-attempt"
CELL = 50_000  # offsets of a partition that one task orders together


def routed(messages: DataFrame, error: str, attempts: int) -> DataFrame:
    """``route`` and the headers to send a message on with: a failing one is retried ``attempts`` times, counted in its ``retry-attempt`` header (absent or not a number: 0)."""
    attempt = F.coalesce(F.try_element_at("headers", F.lit(ATTEMPT)).try_cast("int"), F.lit(0)) + 1
    again = F.col(error).isNotNull() & (attempt <= attempts)
    raised = F.map_concat(F.map_filter(F.coalesce("headers", F.expr("cast(map() as map<string, string>)")), lambda k, v: k != ATTEMPT), F.create_map(F.lit(ATTEMPT), attempt.cast("string")))
    return messages.withColumn("route", F.when(F.col(error).isNull(), "good").when(again, "retry").otherwise("dead")).withColumn("headers", F.when(again, raised).otherwise(F.col("headers")))


def take(batch: DataFrame, batch_id: int, base: str, check: Callable[[DataFrame], DataFrame], attempts: int) -> None:
    """Apply one micro-batch. ``check`` adds a column ``error``, NULL for a good message.

    Messages are shuffled once, into cells of ``CELL`` offsets; gaps and offsets are read from the rows written. Nothing is cached, so adaptive execution fits the tasks of every step to its size.
    """
    spark, zero, folder = batch.sparkSession, F.lit(0).cast("long"), f"batch={batch_id}"
    begin = spark.read.parquet(f"{base}/offsets/batch={batch_id - 1}") if batch_id else batch.select(*PARTITION).distinct().select(*PARTITION, *[zero.alias(c) for c in ("expected", "taken", "replayed")])
    cell, in_cell = F.floor(F.col("offset") / CELL), W.partitionBy(*PARTITION, "__cell").orderBy("offset")

    start = F.broadcast(begin.select(*PARTITION, "expected"))  # a row for each partition
    known = join_back(batch, start, PARTITION, "left").where(F.col("offset") >= F.coalesce("expected", zero)).drop("expected")
    sorted_ = known.withColumn("__cell", cell).withColumn("__last", F.lag("offset").over(in_cell))
    new = sorted_.where(F.col("__last").isNull() | (F.col("offset") > F.col("__last"))).drop("__cell", "__last")
    routed(check(new), "error", attempts).write.mode("overwrite").partitionBy("route").parquet(f"{base}/rows/{folder}")

    fresh = spark.read.schema(batch.select(*PARTITION, "offset").schema).parquet(f"{base}/rows/{folder}").withColumn("__cell", cell)  # may have no row, so no file
    inside = fresh.withColumn("__last", F.lag("offset").over(in_cell)).where(F.col("offset") > F.col("__last") + 1)
    cells = fresh.groupBy(*PARTITION, "__cell").agg(F.min("offset").alias("offset"), F.max("offset").alias("__end"))
    first = join_back(cells.withColumn("__last", F.lag("__end").over(W.partitionBy(*PARTITION).orderBy("__cell"))), start, PARTITION, "left")
    between = first.withColumn("expected", F.coalesce(F.col("__last") + 1, "expected", zero)).where(F.col("offset") > F.col("expected"))
    gaps = inside.select(*PARTITION, (F.col("__last") + 1).alias("expected"), F.col("offset").alias("observed")).unionByName(between.select(*PARTITION, "expected", F.col("offset").alias("observed")))
    gaps.write.mode("overwrite").parquet(f"{base}/gaps/{folder}")

    counts = [batch.groupBy(*PARTITION).agg(zero.alias("expected"), zero.alias("taken"), F.count("*").alias("replayed")),
              fresh.groupBy(*PARTITION).agg((F.max("offset") + 1).alias("expected"), F.count("*").alias("taken"), (-F.count("*")).alias("replayed"))]
    state = begin.select(*PARTITION, "expected", "taken", "replayed").unionByName(counts[0]).unionByName(counts[1])
    state.groupBy(*PARTITION).agg(F.max("expected").alias("expected"), F.sum("taken").alias("taken"), F.sum("replayed").alias("replayed")).write.mode("overwrite").parquet(f"{base}/offsets/{folder}")


def consume(messages: DataFrame, base: str, check: Callable[[DataFrame], DataFrame], attempts: int = 3) -> None:
    """Process all available messages of a stream into the tables under ``base``."""
    messages.writeStream.foreachBatch(lambda batch, batch_id: take(batch, batch_id, base, check, attempts)).option(
        "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def reached(spark: SparkSession, base: str) -> DataFrame:
    """(topic, partition, expected, taken, replayed, gaps, missing) after the last batch."""
    offsets = spark.read.parquet(f"{base}/offsets")
    last = offsets.where(F.col("batch") == F.lit(offsets.agg(F.max("batch")).first()[0])).drop("batch")
    gaps = spark.read.parquet(f"{base}/gaps").groupBy(*PARTITION).agg(F.count("*").alias("gaps"), F.sum(F.col("observed") - F.col("expected")).alias("missing"))
    return join_back(last, gaps, PARTITION, "left").fillna(0, ["gaps", "missing"])


def backlog(spark: SparkSession, base: str, ends: DataFrame, least: int = 1) -> DataFrame:
    """(topic, partition, expected, observed, lag) of the partitions whose end, from ``ends`` (topic, partition, end_offset), is ``least`` offsets ahead or more; one never read is at 0."""
    both = join_back(ends.select(*PARTITION, F.col("end_offset").alias("observed")), reached(spark, base).select(*PARTITION, "expected"), PARTITION, "left").withColumn("expected", F.coalesce("expected", F.lit(0)))
    return both.withColumn("lag", F.greatest(F.col("observed") - F.col("expected"), F.lit(0))).where(F.col("lag") >= least).select(*PARTITION, "expected", "observed", "lag")


class ProgressLog(StreamingQueryListener):
    """The last ``keep`` progress events of all queries, to look at as a table; register with ``spark.streams.addListener``."""

    def __init__(self, keep: int = 1000):
        self.events = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for s in p.sources:
            self.events.append((str(p.id), p.batchId, s.description, s.numInputRows, s.startOffset, s.endOffset, s.latestOffset))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.events), "query string, batch long, source string, rows long, start_offset string, end_offset string, latest_offset string")
