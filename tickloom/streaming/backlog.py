"""Events of several sources behind one watermark: late and repeated ones dropped and counted, idle sources left out, the rest released in order.

A micro-batch is applied as DataFrame steps over the state that the batch before it wrote, so no source and no group is confined to one task. State is kept in tables under
``base``, a folder for each batch; a replayed batch reads its predecessor's folders and overwrites its own. The tables:

* ``marks``: (group, source, latest) largest event time of every source so far, with this batch's counts ``seen``, ``invalid`` and ``expired``;
* ``watermarks``: (group, watermark) after the batch;
* ``events``: every event that the batch had to decide on, by ``fate``: ``ready`` (released now), ``held`` (beyond the watermark, seen again by the next batch) or ``stale``;
* ``recent``: ids that a repeated event could still have;
* ``lags``: (group, source, n, worst, samples) of the delays of accepted events.

The watermark of a group is the smallest of its sources' latest times less the allowed lateness, and never falls. A source whose latest time is more than ``expiration``
behind the group's newest does not count until it catches up. An event is dropped if it arrives more than ``expiration`` after its time (``expired``), or if its time is more than that behind
the watermark (``stale``, also when it was held before).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.exprs import join_back, micros


@dataclass(frozen=True)
class Backlog:
    """Columns of the stream and the two tolerances in seconds. ``ids`` name an event (none: nothing is a repetition); rows with a NULL id are never repetitions."""

    ids: Sequence[str] = ()
    group: Sequence[str] = ()
    source: str = "source"
    event: str = "event_time"
    arrival: str = "arrival_time"
    lateness: float = 60.0
    expiration: float = 3600.0
    samples: int = 512

    def __post_init__(self):
        if self.lateness <= 0 or self.expiration <= 0 or self.samples <= 0:
            raise ValueError("lateness, expiration and samples must be positive")

    @property
    def own(self) -> list[str]:
        return [*self.group, self.source]

    @property
    def life(self) -> int:
        return int(self.expiration * 1e6)


def _store(df: DataFrame, base: str, name: str, batch_id: int, by: str | None = None) -> DataFrame:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(f"{base}/{name}/batch={batch_id}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/{name}/batch={batch_id}")


def _watermarks(marks: DataFrame, spec: Backlog, before: DataFrame | None) -> DataFrame:
    """(group, watermark) in microseconds, NULL without a timed event: the smallest latest time of the sources that are not idle, less the lateness; never below the one before."""
    newest = marks.groupBy(*spec.group).agg(F.max("latest").alias("newest"))
    live = join_back(marks, newest, spec.group).where(F.col("latest") >= F.col("newest") - spec.life)
    now = live.groupBy(*spec.group).agg((F.min("latest") - int(spec.lateness * 1e6)).alias("watermark"))
    return now if before is None else now.unionByName(before).groupBy(*spec.group).agg(F.max("watermark").alias("watermark"))


def _first_of_each(rows: DataFrame, spec: Backlog) -> DataFrame:
    """One row for each id, that of the earliest arrival (then event time, then source); rows with a NULL id stay."""
    named = " and ".join(f"`{c}` is not null" for c in spec.ids)
    rest = [c for c in rows.columns if c not in spec.ids]
    once = rows.where(named).groupBy(*spec.ids).agg(F.min_by(F.struct(*rest), F.struct(spec.arrival, spec.event, spec.source)).alias("r")).select(*spec.ids, "r.*")
    return once.select(*rows.columns).unionByName(rows.where(f"not ({named})"))


def advance(batch: DataFrame, batch_id: int, spec: Backlog, base: str) -> None:
    """Apply one micro-batch to the tables."""
    spark, own, life = batch.sparkSession, spec.own, spec.life
    kept = T.StructType([*batch.schema.fields, *[T.StructField(c, T.LongType()) for c in ("__event", "__arrival", "batch_in")], T.StructField("fate", T.StringType())])
    prior = {n: spark.read.parquet(f"{base}/{n}/batch={batch_id - 1}") for n in ("marks", "watermarks", "recent", "lags")} if batch_id else {}
    if prior:  # may have no row, so no file
        prior["events"] = spark.read.schema(kept).parquet(f"{base}/events/batch={batch_id - 1}")
    rows = batch.withColumns({"__event": micros(spec.event), "__arrival": micros(spec.arrival)}).persist(StorageLevel.MEMORY_AND_DISK)
    valid = F.col("__event").isNotNull() & F.col("__arrival").isNotNull()
    in_time = valid & (F.col("__arrival") - F.col("__event") <= life)

    seen = rows.groupBy(*own).agg(F.max(F.when(in_time, F.col("__event"))).alias("latest"), F.count("*").alias("seen"), F.count_if(~valid).alias("invalid"), F.count_if(valid & ~in_time).alias("expired"))
    if prior:
        idle = prior["marks"].select(*own, "latest", *[F.lit(0).cast("long").alias(c) for c in ("seen", "invalid", "expired")])
        seen = seen.unionByName(idle).groupBy(*own).agg(F.max("latest").alias("latest"), *[F.sum(c).alias(c) for c in ("seen", "invalid", "expired")])
    marks = _store(seen, base, "marks", batch_id)
    watermarks = _store(_watermarks(marks, spec, prior.get("watermarks")), base, "watermarks", batch_id)

    fresh = rows.where(in_time).withColumn("batch_in", F.lit(batch_id).cast("long"))
    if spec.ids:
        fresh = _first_of_each(fresh, spec)
        if prior:
            fresh = fresh.join(prior["recent"].select(*spec.ids), list(spec.ids), "left_anti")
    open_rows = fresh.unionByName(prior["events"].where("fate = 'held'").drop("fate")) if prior else fresh
    fate = F.when(F.col("__event") < F.col("watermark") - life, "stale").when(F.col("__event") <= F.col("watermark"), "ready").otherwise("held")
    events = _store(join_back(open_rows, watermarks, spec.group).withColumn("fate", fate).drop("watermark"), base, "events", batch_id, by="fate")
    taken = events.where((F.col("batch_in") == batch_id) & (F.col("fate") != "stale"))

    if spec.ids:
        ids = taken.select(*spec.group, "__event", *[c for c in spec.ids if c not in spec.group])
        if prior:
            ids = ids.unionByName(prior["recent"])
        # an older event is stale whatever its id
        _store(join_back(ids, watermarks, spec.group).where(F.col("__event") >= F.col("watermark") - life).drop("watermark"), base, "recent", batch_id)
    else:
        _store(watermarks.limit(0), base, "recent", batch_id)

    lag = (F.col("__arrival") - F.col("__event")) / 1e6
    last = F.row_number().over(W.partitionBy(*own).orderBy(F.col("__arrival").desc(), F.col("__event").desc(), *[F.col(c).desc() for c in spec.ids]))
    newest = taken.withColumn("__k", last).where(F.col("__k") <= spec.samples).groupBy(*own).agg(F.collect_list(F.struct(F.col("__arrival").alias("at"), lag.alias("lag"))).alias("samples"))
    lags = join_back(taken.groupBy(*own).agg(F.count("*").alias("n"), F.max(F.greatest(lag, F.lit(0.0))).alias("worst")), newest, own)
    if prior:
        # at most two rows for a source
        lags = lags.unionByName(prior["lags"]).groupBy(*own).agg(F.sum("n").alias("n"), F.max("worst").alias("worst"), F.flatten(F.collect_list("samples")).alias("samples"))
    _store(lags.withColumn("samples", F.slice(F.sort_array("samples", False), 1, spec.samples)), base, "lags", batch_id)
    rows.unpersist()


def run(df: DataFrame, spec: Backlog, base: str) -> None:
    """Process all available input of the stream into the tables under ``base``; call again (or restart) to go on."""
    df.writeStream.foreachBatch(lambda batch, batch_id: advance(batch, batch_id, spec, base)).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def decided(spark: SparkSession, base: str, fate: str) -> DataFrame:
    """Events of one fate, with the batch that decided (``batch``); what is still held is in the last batch only."""
    rows = spark.read.parquet(f"{base}/events").where(F.col("fate") == fate)
    return rows.where(F.col("batch") == F.lit(latest_batch(spark, base))) if fate == "held" else rows


def latest_batch(spark: SparkSession, base: str) -> int:
    return spark.read.parquet(f"{base}/marks").agg(F.max("batch")).first()[0]


def released(spark: SparkSession, base: str, spec: Backlog) -> DataFrame:
    """Released events; by (batch, event time, arrival, ids) they are in order."""
    return decided(spark, base, "ready").orderBy("batch", "__event", "__arrival", *spec.ids)


def progress(spark: SparkSession, base: str) -> DataFrame:
    """(batch, group, watermark in microseconds) after every batch."""
    return spark.read.parquet(f"{base}/watermarks")


def summary(spark: SparkSession, base: str, spec: Backlog) -> DataFrame:
    """Counts of each source over all batches: ``seen`` = invalid + expired + repeated + stale + released + held."""
    counts = spark.read.parquet(f"{base}/marks").groupBy(*spec.own).agg(*[F.sum(c).alias(c) for c in ("seen", "invalid", "expired")])
    events = spark.read.parquet(f"{base}/events")
    last = latest_batch(spark, base)
    fates = events.groupBy(*spec.own).agg(F.count_if(F.col("fate") == "stale").alias("stale"), F.count_if(F.col("fate") == "ready").alias("released"),
                                          F.count_if((F.col("fate") == "held") & (F.col("batch") == last)).alias("held"))
    both = join_back(counts, fates, spec.own, "left").fillna(0, ["stale", "released", "held"])
    return both.withColumn("repeated", F.col("seen") - F.col("invalid") - F.col("expired") - F.col("stale") - F.col("released") - F.col("held"))


def lag_summary(spark: SparkSession, base: str, spec: Backlog) -> DataFrame:
    """(group, source, n, mean, worst, p95) of the delays in seconds: count and maximum over all accepted events, mean and interpolated 95th percentile over the last ``samples`` to arrive."""
    lags = spark.read.parquet(f"{base}/lags").where(F.col("batch") == F.lit(latest_batch(spark, base)))
    sorted_ = lags.withColumn("x", F.array_sort(F.transform("samples", lambda s: s["lag"])))
    place = F.lit(0.95) * (F.size("x") - 1)
    low = F.floor(place).cast("int")
    a, b = F.element_at("x", low + 1), F.element_at("x", F.least(low + 2, F.size("x")))
    return sorted_.select(*spec.own, "n", (F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x")).alias("mean"), "worst", (a + (b - a) * (place - low)).alias("p95"))
