"""Record shapes of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(28, 10)

TICK = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("venue", T.StringType()),
    T.StructField("instrument_type", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("price", MONEY), T.StructField("volume", MONEY), T.StructField("trade_id", T.StringType())])

BAR = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("venue", T.StringType()),
    T.StructField("ts", T.TimestampType()), T.StructField("interval_seconds", T.LongType()),
    *[T.StructField(c, MONEY) for c in ("open", "high", "low", "close", "volume")]])

LEVELS = T.ArrayType(T.StructType([T.StructField("price", MONEY), T.StructField("quantity", MONEY)]))

BOOK_SNAPSHOT = T.StructType([
    T.StructField("instrument", T.StringType()), T.StructField("sequence", T.LongType()),
    T.StructField("bids", LEVELS), T.StructField("asks", LEVELS),
    T.StructField("ts_event", T.TimestampType()), T.StructField("ts_arrival", T.TimestampType()),
    T.StructField("source", T.StringType())])

BOOK_DIFF = T.StructType([
    T.StructField("instrument", T.StringType()), T.StructField("sequence_start", T.LongType()),
    T.StructField("sequence_end", T.LongType()), T.StructField("bids", LEVELS), T.StructField("asks", LEVELS),
    T.StructField("ts_event", T.TimestampType()), T.StructField("ts_arrival", T.TimestampType()),
    T.StructField("source", T.StringType())])

# JSON payload of a tick message. Numbers are read as text so that a bad one is NULL, not a failure.
TICK_MESSAGE = T.StructType([
    T.StructField(c, T.StringType())
    for c in ("symbol", "venue", "instrument_type", "timestamp", "price", "volume", "trade_id")])

FILL = T.StructType([
    T.StructField("order_id", T.LongType()), T.StructField("broker", T.StringType()),
    T.StructField("venue", T.StringType()), T.StructField("ts", T.TimestampType()),
    T.StructField("quantity", T.DoubleType()), T.StructField("price", T.DoubleType()),
    T.StructField("fees", T.DoubleType())])
