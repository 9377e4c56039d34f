"""Streams replayed from the event files, and user functions."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickloom.functions.exprs import micros
from tickloom.operators import arbitrage as A
from tickloom.operators import udfs as U
from tickloom.plans.aggregates import rnd
from tickloom.plans.execution import RULE, TRADES, quotes_and_balances, shown
from tickloom.plans.registry import query
from tickloom.plans.windows import W, ema
from tickloom.session import scratch_dir
from tickloom.sources.decode import decode_ticks
from tickloom.streaming import core as S


VENUES = ("click", "error", "purchase", "signup", "view")
FILES = 8  # micro-batches that the events arrive in
FILE_ROWS = 5_000_000
_arrived: dict[tuple, tuple[str, int]] = {}


def in_slots(t, name: str, rows, slot: str) -> tuple[str, int]:
    """``rows`` as a folder of files that a source takes slot by slot (column ``slot``, from 0), and the files of a slot. Written once for each state of the table ``events``.

    Slots are written by the executors, in as many files as their rows need.
    """
    state = t.raw("events").select(F.max("_metadata.file_modification_time").cast("string"), F.count("*")).first()
    key = (t.spark.sparkContext.applicationId, t.dir, name, *state)
    if key not in _arrived:
        path, files = scratch_dir(t.spark, name), -(-state[1] // (FILES * FILE_ROWS)) or 1
        part = F.pmod(F.xxhash64("event_id"), F.lit(files))
        rows.repartition(FILES * files, slot, part).write.partitionBy(slot).parquet(path)
        _arrived[key] = path, S.stamp_files(t.spark, path)
    return _arrived[key]


def event_files(t) -> tuple[str, int]:
    """The events in time order; a day is in one slot, so daily values have one batch to come from. Events without a time are in the first."""
    rows = t.raw("events")
    day = F.unix_micros(F.date_trunc("day", "ts"))
    cuts = sorted(set(rows.select(F.percentile_approx(day, [i / FILES for i in range(1, FILES)], 10_000)).first()[0] or []))
    slot = sum((F.coalesce(day >= c, F.lit(False)).cast("int") for c in cuts), F.lit(0))
    return in_slots(t, "events", rows.withColumn("slot", slot), "slot")


def ticks(t):
    path, files = event_files(t)
    raw = S.stream_table(t.spark, path, files_per_batch=files)
    return raw.select(F.col("user_id").cast("string").alias("symbol"), F.col("event_type").alias("venue"), F.col("ts").cast("timestamp").alias("ts"),
                      F.col("event_id").alias("seq"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"))


@query("t1_stream_bars", """
SELECT symbol, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS bucket, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, sum(volume) AS volume, count(*) AS trade_count
FROM ticks GROUP BY symbol, time_bucket(INTERVAL '1 hour', ts) HAVING time_bucket(INTERVAL '1 hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ticks) - INTERVAL 5 MINUTES""")
def t1(t):
    return S.drain(S.stream_bars(ticks(t), ["symbol"], width="1 hour"), "t1").withColumn("bucket", micros("bucket"))


@query("t2_min_watermark_merge", "SELECT venue, count(*) AS rows FROM ticks GROUP BY venue")
def t2(t):
    parts = [ticks(t).filter(F.col("venue") == v).withWatermark("ts", "10 minutes") for v in VENUES]
    return S.drain(S.merge_streams(parts), "t2").groupBy("venue").agg(F.count(F.lit(1)).alias("rows"))


def arrivals(d):
    return d.withColumn("event_time", F.col("ts")).withColumn("arrival_time", F.timestamp_micros(micros("ts") + (F.col("volume") * 1e6).cast("long")))


@query("t3_late_policy", "SELECT seq FROM ticks WHERE volume <= 60")
def t3(t):
    return S.drain(S.drop_late(arrivals(ticks(t)), expiration=60.0).select("seq"), "t3")


@query("t3_late_counts", "SELECT venue, count(*) AS seen, count(*) FILTER (WHERE volume > 60) AS dropped FROM ticks GROUP BY venue")
def t3b(t):
    return S.late_counts(arrivals(t.ticks), ["venue"], expiration=60.0)


@query("t4_ordered_release", """
SELECT venue, epoch_us(ts) AS event_us, seq FROM ticks k WHERE epoch_us(ts) <= (SELECT max(epoch_us(ts)) FROM ticks m WHERE m.venue = k.venue) - 3600000000""")
def t4(t):
    return S.drain(S.ordered_release(ticks(t), ["venue"], ["ts", "seq"], "seq", 3_600_000_000), "t4")


@query("t6_lag_windows", """
SELECT venue, epoch_us(time_bucket(INTERVAL '1 day', ts)) AS bucket, count(*) AS n, max(volume) AS worst FROM ticks GROUP BY venue, time_bucket(INTERVAL '1 day', ts)
HAVING time_bucket(INTERVAL '1 day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM ticks) - INTERVAL 1 HOUR""")
def t6(t):
    out = S.sliding(ticks(t), ["venue"], {"n": F.count(F.lit(1)), "worst": F.max("volume")}, width="1 day", slide="1 day", delay="1 hour")
    return S.drain(out, "t6").withColumn("bucket", micros("bucket"))


@query("t7_stream_dedupe", "SELECT seq, price FROM ticks")
def t7(t):
    both = S.merge_streams([ticks(t), ticks(t)])
    return S.drain(S.dedupe(both, ["seq"], delay="1 hour").select("seq", "price"), "t7")


@query("t8_online_ema", f"SELECT symbol, seq, round({ema('price', '0.2')}, 6) AS ema FROM ticks {W}")
def t8(t):
    return rnd(S.drain(S.online_ema(ticks(t), ["symbol"], ["ts", "seq"], "price", 0.2), "t8"), "ema")


@query("t8_online_amm")
def t8b(t):
    d = ticks(t).withColumns({"x": F.col("price") / 5000 - 0.01, "R": F.col("volume") / 100, "kappa": 0.2 - F.col("price") / 1000})
    return S.drain(S.online_amm(d, ["symbol"], ["ts", "seq"], "x", "R", "kappa"), "t8b")


POSITIONS = """
WITH RECURSIVE o AS (SELECT symbol, seq, price AS p, CASE WHEN seq % 2 = 0 THEN volume + 1 ELSE -volume - 1 END AS q, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS k FROM ticks),
f AS (SELECT symbol, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS held, CAST(0 AS DOUBLE) AS entry, CAST(0 AS DOUBLE) AS realized FROM o GROUP BY 1
  UNION ALL SELECT o.symbol, o.k, held + q, CASE WHEN held * q >= 0 THEN CASE WHEN held = 0 THEN p ELSE (entry * abs(held) + p * abs(q)) / (abs(held) + abs(q)) END WHEN held + q = 0 THEN 0 WHEN abs(q) > abs(held) THEN p ELSE entry END,
    realized + CASE WHEN held * q >= 0 THEN 0 ELSE least(abs(held), abs(q)) * (p - entry) * sign(held) END FROM f JOIN o ON o.symbol = f.symbol AND o.k = f.k + 1)"""


@query("t9_online_positions", POSITIONS + " SELECT symbol, seq, held AS position, round(entry, 4) AS entry_price, round(realized, 3) AS realized FROM f JOIN o USING (symbol, k)")
def t9(t):
    d = ticks(t).withColumn("q", F.when(F.col("seq") % 2 == 0, F.col("volume") + 1).otherwise(-F.col("volume") - 1))
    got = S.drain(S.online_positions(d, ["symbol"], ["ts", "seq"], "q", "price"), "t9")
    return rnd(rnd(got, "entry_price", digits=4), "realized", digits=3)


@query("t10_online_arbitrage", TRADES)
def t10(t):
    quotes, held = quotes_and_balances(ticks(t))
    both = A.messages(quotes, held, t.by_symbol, "venue")
    return shown(S.drain(S.online_arbitrage(both, ["symbol"], ["ts", "seq"], RULE), "t10"))


@query("f5_stream_materialise", "SELECT symbol, epoch_us(time_bucket(INTERVAL '1 day', ts)) AS ts, arg_max(price, seq) AS price FROM ticks GROUP BY 1, 2")
def f5(t):
    base = scratch_dir(t.spark, "f5")
    d = ticks(t).select("symbol", F.date_trunc("day", "ts").alias("ts"), "seq", "price")
    S.materialise_features(d, ["symbol", "ts"], ["seq"], f"{base}/table", f"{base}/ckpt")
    return t.spark.read.parquet(f"{base}/table").select("symbol", micros("ts").alias("ts"), "price")


@query("t12_hot_buffer", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM ticks)
SELECT symbol, CAST(max(n) // 10 AS BIGINT) AS flushes, round(sum(price), 2) AS flushed, max(price) AS highest FROM n WHERE k <= n // 10 * 10 GROUP BY symbol""")
def t12(t):
    return S.drain(S.hot_buffer(ticks(t), ["symbol"], ["ts", "seq"], "price", 10), "t12").groupBy("symbol").agg(
        F.count(F.lit(1)).alias("flushes"), F.round(F.sum(F.aggregate("values", F.lit(0.0), lambda a, x: a + x)), 2).alias("flushed"), F.max(F.array_max("values")).alias("highest"))


@query("t13_route_dead_letters", "SELECT count(*) FILTER (WHERE seq % 20 <> 3) AS good, count(*) FILTER (WHERE seq % 20 = 3) AS dead FROM ticks")
def t13(t):
    base = scratch_dir(t.spark, "t13")
    body = F.to_json(F.struct("symbol", "venue", (micros("ts") / 1e6).alias("timestamp"), F.when(F.col("seq") % 20 != 3, F.col("price")).alias("price")))
    d = decode_ticks(ticks(t).select(body.alias("value"), F.col("symbol").alias("key"), F.create_map(F.lit("a"), F.lit("b")).alias("headers")))
    S.route(d, "error", f"{base}/good", f"{base}/dead", f"{base}/ckpt")
    n = lambda p: t.spark.read.parquet(f"{base}/{p}").agg(F.count(F.lit(1)).alias(p))
    return n("good").crossJoin(n("dead"))


@query("t14_book_ingest", f"""
WITH p AS (SELECT symbol, seq, seq + volume * 50 AS e, max(seq + volume * 50) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ticks)
SELECT symbol, count(*) AS stale FROM p WHERE e < m + 1 GROUP BY symbol""")
def t14(t):
    d = ticks(t).withColumns({"sequence_start": F.col("seq"), "sequence_end": F.col("seq") + (F.col("volume") * 50).cast("long")})
    out = S.drain(S.book_ingest(d, ["symbol"], ["ts", "seq"], every=10), "t14")
    return out.filter("kind = 'stale'").groupBy("symbol").agg(F.count(F.lit(1)).alias("stale"))


@query("t15_sliding_windows", """
WITH x AS (SELECT venue, price, unnest([0, 1]) AS k, ts FROM ticks), w AS (SELECT venue, price, time_bucket(INTERVAL '6 hours', ts) - k * INTERVAL 6 HOURS AS b FROM x)
SELECT venue, epoch_us(b) AS bucket, count(*) AS n, max(price) AS top FROM w GROUP BY venue, b HAVING b + INTERVAL 12 HOURS <= (SELECT max(ts) FROM ticks) - INTERVAL 1 HOUR""")
def t15(t):
    out = S.sliding(ticks(t), ["venue"], {"n": F.count(F.lit(1)), "top": F.max("price")}, width="12 hours", slide="6 hours", delay="1 hour")
    return S.drain(out, "t15").withColumn("bucket", micros("bucket"))


@query("t16_rolling_buffer", "SELECT symbol, seq, round(avg(price) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS 6 PRECEDING), 6) AS mean FROM ticks")
def t16(t):
    return rnd(S.drain(S.rolling_buffer(ticks(t), ["symbol"], ["ts", "seq"], "price", 7), "t16"), "mean")


@query("s14_merge_streams", "SELECT seq, venue FROM ticks")
def s14(t):
    return S.drain(S.merge_streams([ticks(t).filter(F.col("venue") == v).select("seq", "venue") for v in VENUES]), "s14")


@query("v1_feature_block", """
SELECT symbol, 'peak' AS name, max(price) AS value FROM ticks GROUP BY symbol UNION ALL SELECT symbol, 'rows', CAST(count(price) AS DOUBLE) FROM ticks GROUP BY symbol""")
def v1(t):
    U.feature("peak")(lambda c: F.max(c))
    U.feature("rows")(lambda c: F.count(c))
    return U.feature_block(t.ticks, ["symbol"], "price", ["peak", "rows"]).drop("metadata")


@query("v2_wrapped_function", "SELECT symbol, round(max(price) - min(price), 6) AS range FROM ticks GROUP BY symbol")
def v2(t):
    spread = U.wrap_function(lambda x: x.max() - x.min())
    return rnd(t.ticks.groupBy("symbol").agg(spread("price").alias("range")), "range")


@query("v3_user_signals", "SELECT symbol, seq, CASE WHEN price > avg(price) OVER (PARTITION BY symbol) THEN 1.0 ELSE -1.0 END::DOUBLE AS signal FROM ticks")
def v3(t):
    return U.user_signals(t.ticks, t.by_symbol, "price", lambda p: np.where(p > p.mean(), 1.0, -1.0)).select("symbol", "seq", "signal")


@query("v5_rollup_spec", "SELECT venue, CAST(sum(volume) AS BIGINT) AS total, round(avg(price), 6) AS mean FROM ticks GROUP BY venue")
def v5(t):
    spec = [U.RollupColumn("total", "sum(volume)", "bigint"), U.RollupColumn("mean", "round(avg(price), 6)", "double")]
    return U.rollup(t.ticks, ["venue"], spec)


@query("v6_gap_loader", "SELECT symbol, epoch_us(day) + i * 3600000000 AS at, i AS hour FROM (SELECT DISTINCT symbol, time_bucket(INTERVAL '1 day', ts) AS day FROM ticks), range(3) r(i)")
def v6(t):
    gaps = t.ticks.select("symbol", micros(F.date_trunc("day", "ts")).alias("day")).distinct()
    return U.load_gaps(gaps, lambda g: pd.DataFrame({"symbol": [g["symbol"]] * 3, "at": [g["day"] + i * 3_600_000_000 for i in range(3)], "hour": range(3)}), "symbol string, at long, hour long")


@query("s14_isolated_streams", "SELECT seq, venue, NULL AS error FROM ticks WHERE venue <> 'signup' UNION ALL SELECT NULL, 'signup', 'failed'")
def s14b(t):
    """One stream for each venue; that of ``signup`` cannot be read. The others are whole, and the failure is told."""
    def stream(v):
        d = ticks(t).filter(F.col("venue") == v).select("seq", "venue")
        return d.withColumn("venue", F.when(F.col("seq") >= 0, F.raise_error(F.lit("bad message"))).otherwise(F.col("venue"))) if v == "signup" else d

    rows, failed = S.drain_each({v: stream(v) for v in VENUES}, "isolated")
    told = t.spark.createDataFrame([(None, v, "failed") for v in failed], "seq long, venue string, error string")
    return rows.select("seq", "venue", F.lit(None).cast("string").alias("error")).unionByName(told)
