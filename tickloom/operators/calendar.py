"""Trading sessions and time arithmetic, with time zones and daylight saving left to Spark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.exprs import micros


@dataclass(frozen=True)
class Market:
    """Hours as ``HH:MM:SS`` local wall time per weekday (0 = Monday); a close not after the open is on the next day."""

    name: str
    tz: str
    hours: Mapping[int, tuple[str, str]]
    holidays: Sequence[str] = ()
    special: Mapping[str, tuple[str, str]] = field(default_factory=dict)


def _secs(text: str) -> int:
    parts = [int(x) for x in text.split(":")] + [0, 0]
    return parts[0] * 3600 + parts[1] * 60 + parts[2]


def hours_table(spark: SparkSession, markets: Sequence[Market]) -> DataFrame:
    rows = []
    for m in markets:
        rows += [(m.name, m.tz, d, None, _secs(o), _secs(c)) for d, (o, c) in m.hours.items()]
        rows += [(m.name, m.tz, None, day, _secs(o), _secs(c)) for day, (o, c) in m.special.items()]
        rows += [(m.name, m.tz, None, day, None, None) for day in m.holidays]
    return spark.createDataFrame(rows, "market string, tz string, weekday int, day string, open_s int, close_s int").withColumn(
        "day", F.col("day").cast("date"))


def sessions(bounds: DataFrame, markets: Sequence[Market]) -> DataFrame:
    """Sessions (market, session_date, open_ts, close_ts) touching the closed range of the one-row ``bounds(start, end)``.

    A holiday beats a special session, which beats the weekday's hours.
    """
    table = hours_table(bounds.sparkSession, markets)
    days = bounds.select("start", "end", F.explode(F.sequence(
        F.to_date(F.col("start") - F.expr("interval 2 days")), F.to_date(F.col("end") + F.expr("interval 2 days")))).alias("session_date"))
    rank = F.when(F.col("day").isNotNull() & F.col("open_s").isNull(), 0).when(F.col("day").isNotNull(), 1).otherwise(2)
    match = (F.col("day") == F.col("session_date")) | (F.col("weekday") == F.weekday("session_date"))
    best = days.join(F.broadcast(table), match).groupBy("market", "tz", "session_date", "start", "end").agg(
        F.min_by(F.struct("open_s", "close_s"), rank).alias("h")).filter(F.col("h.open_s").isNotNull())
    wall = lambda s: F.to_utc_timestamp(
        F.timestamp_seconds(F.unix_date("session_date").cast("long") * 86400 + s), F.col("tz"))
    close = F.when(F.col("h.close_s") <= F.col("h.open_s"), F.col("h.close_s") + 86400).otherwise(F.col("h.close_s"))
    out = best.withColumn("open_ts", wall(F.col("h.open_s"))).withColumn("close_ts", wall(close))
    return out.filter((F.col("close_ts") >= F.col("start")) & (F.col("open_ts") <= F.col("end"))).select(
        "market", "tz", "session_date", "open_ts", "close_ts")


def span_of(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.min(ts).alias("start"), F.max(ts).alias("end"))


def with_open_flag(df: DataFrame, table: DataFrame, *, ts: str = "ts", market: str = "market", inclusive_close: bool = False) -> DataFrame:
    """``is_open`` by the session of the local date: ``open <= t < close`` (or ``<= close``).

    One equi join on (market, local date); a row has at most one session.
    """
    tz = table.groupBy("market").agg(F.first("tz").alias("__tz"))
    d = df.join(F.broadcast(tz), df[market] == tz["market"], "left").drop(tz["market"])
    d = d.withColumn("session_date", F.to_date(F.from_utc_timestamp(ts, F.col("__tz"))))
    s = table.select(F.col("market").alias(market), "session_date", "open_ts", "close_ts")
    d = d.join(s, [market, "session_date"], "left")
    upper = F.col(ts) <= F.col("close_ts") if inclusive_close else F.col(ts) < F.col("close_ts")
    flag = F.coalesce((F.col(ts) >= F.col("open_ts")) & upper, F.lit(False))
    return d.select(*df.columns, flag.alias("is_open"))


def next_open(df: DataFrame, table: DataFrame, *, ts: str = "ts", market: str = "market") -> DataFrame:
    """First session open strictly after the time."""
    from tickloom.operators.joins import asof

    s = table.select(F.col("market").alias(market), F.col("open_ts").alias("at"), F.col("open_ts").alias("next_open"))
    return asof(df, s, keys=[market], ts=ts, right_ts="at", values=["next_open"], direction="forward", strict=True).drop("matched_ts")


def previous_close(df: DataFrame, table: DataFrame, *, ts: str = "ts", market: str = "market") -> DataFrame:
    """Close of the last session that opened at or before the time (the running session counts)."""
    from tickloom.operators.joins import asof

    s = table.select(F.col("market").alias(market), F.col("open_ts").alias("at"), F.col("close_ts").alias("previous_close"))
    return asof(df, s, keys=[market], ts=ts, right_ts="at", values=["previous_close"]).drop("matched_ts")


def session_events(table: DataFrame) -> DataFrame:
    """Opens and closes as rows in time order; a close comes before an open at the same time."""
    e = table.select("market", F.explode(F.array(
        F.struct(F.lit("open").alias("kind"), F.col("open_ts").alias("ts")),
        F.struct(F.lit("close").alias("kind"), F.col("close_ts").alias("ts")))).alias("e")).select("market", "e.kind", "e.ts")
    return e.orderBy("ts", "kind", "market")


def trading_windows(table: DataFrame, bounds: DataFrame, mode: str = "union", n_markets: int | None = None) -> DataFrame:
    """Maximal stretches between session events in which any (or every) market is open, with the number open.

    The sweep runs over session events: one row per market and day, whatever the size of the tick tables.
    """
    if mode not in ("union", "intersection"):
        raise ValueError("mode is union or intersection")
    e = session_events(table).crossJoin(F.broadcast(bounds))
    at = F.least(F.greatest("ts", "start"), "end")
    step = F.when(F.col("kind") == "open", 1).otherwise(-1)
    pts = e.groupBy(at.alias("at"), "end").agg(F.sum(step).alias("d"), F.sum(F.when(F.col("kind") == "open", 1).otherwise(0)).alias("o"))
    w = W.partitionBy("end").orderBy("at")
    sweep = pts.withColumn("open_markets", F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn(
        "until", F.coalesce(F.lead("at").over(w), F.col("end")))
    need = F.col("open_markets") >= (1 if mode == "union" else n_markets)
    return sweep.filter(need & (F.col("at") < F.col("until"))).select(
        F.col("at").alias("window_start"), F.col("until").alias("window_end"), "open_markets")


def session_grid(table: DataFrame, step: float, ts: str = "ts") -> DataFrame:
    """Expected times inside sessions; the stride restarts at every open."""
    width = int(round(step * 1e6))
    last = F.floor((micros("close_ts") - micros("open_ts") - 1) / width)
    return table.select("market", "session_date", "open_ts", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("i")).select(
        "market", "session_date", F.timestamp_micros(micros("open_ts") + F.col("i") * width).alias(ts))


def alignment(data: DataFrame, expected: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Present against expected times per key: missing, extra, repeated, aligned."""
    on = [*keys, ts]
    got = data.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    both = expected.select(*on).withColumn("__e", F.lit(True)).join(got, on, "full_outer")
    rep = both.groupBy(*keys).agg(
        F.count_if(F.col("__n").isNull()).alias("missing"), F.count_if(F.col("__e").isNull()).alias("extra"),
        F.count_if(F.col("__n") > 1).alias("repeated"))
    return rep.withColumn("aligned", (F.col("missing") + F.col("extra") + F.col("repeated")) == 0)


def to_zone(ts: Column, tz: str) -> Column:
    """Local wall time of a UTC instant."""
    return F.from_utc_timestamp(ts, tz)


def from_zone(ts: Column, tz: str) -> Column:
    return F.to_utc_timestamp(ts, tz)


def bucket_floor(ts: Column, width: float) -> Column:
    """Epoch seconds of the bucket start."""
    return (F.floor(micros(ts) / int(width * 1e6)) * int(width)).cast("long")
