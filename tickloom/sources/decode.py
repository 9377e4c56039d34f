"""Message decoding: tick JSON, exchange book JSON, typed tick events, dead letters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.exprs import ladder, micros
from tickloom.schemas import TICK_MESSAGE


def _nonblank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _instant(text: Column) -> Column:
    """Epoch seconds or ISO text."""
    number = text.try_cast("double")
    return F.coalesce(F.timestamp_micros(F.round(number * 1e6).cast("long")), F.try_to_timestamp(text))


def decode_ticks(messages: DataFrame, *, value: str = "value", key: str | None = "key", headers: str | None = "headers") -> DataFrame:
    """Tick rows from JSON messages; headers (a map) and the key stand in for missing fields.

    ``error`` is NULL for a good row, otherwise why it cannot be used.
    """
    body = F.from_json(F.col(value).cast("string"), TICK_MESSAGE)
    d = messages.withColumn("__m", body)

    def field(name: str, header: str | None = None, default: Column | None = None) -> Column:
        parts = [_nonblank(F.col(f"__m.{name}"))]
        if headers:
            parts.append(F.try_element_at(F.col(headers), F.lit(header or name)))
        if default is not None:
            parts.append(default)
        return F.coalesce(*parts)

    symbol = field("symbol", default=F.col(key).cast("string") if key else None)
    out = d.select(
        *[c for c in messages.columns],
        symbol.alias("symbol"), field("venue").alias("venue"),
        field("instrument_type", default=F.lit("spot")).alias("instrument_type"),
        _instant(field("timestamp", "occurred_at")).alias("ts"),
        F.col("__m.price").try_cast("double").alias("price"),
        F.coalesce(F.col("__m.volume"), F.lit("0")).try_cast("double").alias("volume"),
        field("trade_id").alias("trade_id"))
    why = ladder([
        (F.length(F.coalesce(F.col(value).cast("string"), F.lit(""))) == 0, "empty"),
        (F.col("symbol").isNull() | F.col("venue").isNull(), "symbol_or_venue"),
        (~F.col("instrument_type").isin("spot", "futures"), "instrument_type"),
        (F.col("ts").isNull(), "timestamp"),
        (F.col("price").isNull() | (F.col("price") < 0), "price"),
        (F.col("volume").isNull() | (F.col("volume") < 0), "volume")], F.lit(None).cast("string"))
    return out.withColumn("error", why)


def to_tick_event(ticks: DataFrame, *, required: Sequence[str] = ("symbol", "timestamp", "last_price")) -> DataFrame:
    """Quote-style events where bid, ask and last are the trade price; ``reason`` marks dead letters."""
    event = ticks.select(
        "*", micros("ts").alias("timestamp"), F.col("price").alias("bid_price"), F.col("price").alias("ask_price"),
        F.col("price").alias("last_price"), F.col("volume").cast("long").alias("volume_units"))
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    return event.withColumn("reason", F.when(missing, "schema_mismatch"))


def event_price(last: Column, bid: Column, ask: Column) -> Column:
    """Last, else bid, else ask; a zero counts as absent."""
    return F.coalesce(F.nullif(last, F.lit(0.0)), F.nullif(bid, F.lit(0.0)), F.nullif(ask, F.lit(0.0)))


_PAIRS = T.ArrayType(T.ArrayType(T.StringType()))


def _levels(c: str) -> Column:
    money = "decimal(28,10)"
    return F.transform(F.col(c), lambda l: F.struct(l[0].cast(money).alias("price"), l[1].cast(money).alias("quantity")))


def decode_update_id_books(raw: DataFrame, *, body: str = "body", instrument: str = "instrument", arrival: str = "ts_arrival") -> DataFrame:
    """Books of feeds numbered by ``lastUpdateId`` (snapshots) and ``U``/``u`` (diffs)."""
    # field names differ in letter case only, so they are read one by one
    text = F.col(body)
    one = lambda path, t: F.get_json_object(text, path).cast(t)
    arr = lambda path: F.from_json(F.get_json_object(text, path), _PAIRS)
    stamp = one("$.E", "double")
    at = F.when(stamp.isNull(), F.col(arrival)).otherwise(F.timestamp_micros(
        F.round(F.when(stamp > 1e12, stamp / 1000).otherwise(stamp) * 1e6).cast("long")))
    snap = one("$.lastUpdateId", "long")
    d = raw.select(
        F.when(snap.isNotNull(), "snapshot").otherwise("diff").alias("kind"),
        F.coalesce(one("$.s", "string"), F.col(instrument)).alias("instrument"),
        F.coalesce(snap, one("$.U", "long")).alias("sequence_start"),
        F.coalesce(snap, one("$.u", "long")).alias("sequence_end"),
        F.coalesce(arr("$.bids"), arr("$.b")).alias("__b"), F.coalesce(arr("$.asks"), arr("$.a")).alias("__a"),
        at.alias("ts_event"), F.col(arrival).alias("ts_arrival"))
    return d.withColumn("bids", _levels("__b")).withColumn("asks", _levels("__a")).drop("__a", "__b")


def decode_seq_id_books(raw: DataFrame, *, body: str = "body", arrival: str = "ts_arrival") -> DataFrame:
    """Books of feeds with ``seqId``/``prevSeqId`` inside a ``data`` array."""
    item = T.StructType([
        T.StructField("instId", T.StringType()), T.StructField("seqId", T.LongType()), T.StructField("prevSeqId", T.LongType()),
        T.StructField("ts", T.StringType()), T.StructField("action", T.StringType()),
        T.StructField("bids", _PAIRS), T.StructField("asks", _PAIRS)])
    shape = T.StructType([
        T.StructField("action", T.StringType()), T.StructField("arg", T.StructType([T.StructField("instId", T.StringType())])),
        T.StructField("data", T.ArrayType(item))])
    d = raw.select(F.from_json(body, shape).alias("m"), F.col(arrival).alias("ts_arrival"))
    d = d.withColumn("x", F.try_element_at("m.data", F.lit(1)))
    seq, prev = F.col("x.seqId"), F.coalesce("x.prevSeqId", "x.seqId")
    snap = (F.coalesce("m.action", "x.action") == "snapshot") | (prev == seq)
    d = d.select(
        F.when(F.coalesce(snap, F.lit(False)), "snapshot").otherwise("diff").alias("kind"),
        F.coalesce("x.instId", "m.arg.instId").alias("instrument"),
        F.when(F.coalesce(snap, F.lit(False)), seq).otherwise(prev + 1).alias("sequence_start"), seq.alias("sequence_end"),
        F.col("x.bids").alias("__b"), F.col("x.asks").alias("__a"),
        F.timestamp_millis(F.col("x.ts").cast("long")).alias("ts_event"), "ts_arrival")
    return d.withColumn("bids", _levels("__b")).withColumn("asks", _levels("__a")).drop("__a", "__b")


def dead_letters(df: DataFrame, reason: str, context: Mapping[str, str] | None = None) -> DataFrame:
    """Failed rows as (payload, reason, context) records."""
    body = F.to_json(F.struct(*[c for c in df.columns if c != reason]))
    ctx = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in (context or {"source": "stream"}).items()]))
    return df.filter(F.col(reason).isNotNull()).select(body.alias("payload"), F.col(reason).alias("reason"), ctx.alias("context"))
