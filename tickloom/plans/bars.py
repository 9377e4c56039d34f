"""Bars, grids, fills and resampling over the event ticks."""

from pyspark.sql import functions as F

from tickloom.functions.exprs import micros, round_scaled
from tickloom.operators import bars as B
from tickloom.operators.axis import Axis, trailing, windowed
from tickloom.operators.windows import pct_change
from tickloom.plans.registry import query
from tickloom.plans.tables import Tables

HOUR, DAY = 3600.0, 86400.0
BIN = "time_bucket(INTERVAL '{}', ts)"
TB = Axis(("venue",), "ts", (), grain=DAY)


def r(*cols):
    return [round_scaled(F.col(c), 6).alias(c) for c in cols]


def us(c, name=None):
    return micros(c).alias(name or c)


@query("flagship_bars_features", """
WITH bars AS (SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS bucket, arg_min(price, ts) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, ts) AS close, sum(volume) AS volume FROM ticks GROUP BY 1, 2),
f AS (SELECT *, close / lag(close) OVER w - 1 AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bucket))
SELECT symbol, epoch_us(bucket) AS bucket, open, high, low, close, volume, round(ret, 6) AS ret,
  CASE WHEN count(close) OVER s = 5 THEN round(avg(close) OVER s, 6) END AS sma_5,
  CASE WHEN count(ret) OVER s = 5 THEN round(stddev_samp(ret) OVER s, 6) END AS vol_5
FROM f WINDOW s AS (PARTITION BY symbol ORDER BY bucket ROWS 4 PRECEDING)""")
def flagship(t: Tables):
    bars = B.ohlcv(t.ticks, t.by_symbol, HOUR)

    def build(d, w):
        d = d.withColumn("ret", pct_change("close", w))
        s = trailing(w, 5)
        return d.withColumn("sma_5", F.when(F.count("close").over(s) == 5, F.avg("close").over(s))).withColumn(
            "vol_5", F.when(F.count("ret").over(s) == 5, F.stddev_samp("ret").over(s)))

    out = windowed(bars, Axis(("symbol",), "bucket", (), grain=DAY), build, back=5)
    return out.select("symbol", us("bucket"), "open", "high", "low", "close", "volume", *r("ret", "sma_5", "vol_5")).orderBy(
        "symbol", "bucket")


@query("c1_time_grid", """
SELECT venue, epoch_us(unnest(generate_series(min(time_bucket(INTERVAL '15 minutes', ts)),
  max(time_bucket(INTERVAL '15 minutes', ts)), INTERVAL '15 minutes'))) AS ts FROM ticks GROUP BY venue""")
def grid(t):
    return B.grid_of(t.ticks, t.by_venue, 900.0).select("venue", us("ts"))


FILLED = """
WITH b AS (SELECT venue, time_bucket(INTERVAL '30 minutes', ts) AS ts, arg_max(price, (ticks.ts, seq)) AS price, sum(volume) AS volume
  FROM ticks GROUP BY 1, 2),
g AS (SELECT venue, unnest(generate_series(min(ts), max(ts), INTERVAL '30 minutes')) AS ts FROM b GROUP BY venue),
j AS (SELECT g.venue, g.ts, b.price, b.volume FROM g LEFT JOIN b USING (venue, ts))"""


def gappy(t):
    last = t.ticks.groupBy("venue", F.window("ts", "30 minutes").start.alias("ts")).agg(
        F.max_by("price", F.struct("ts", "seq")).alias("price"), F.sum("volume").alias("volume"))
    return B.grid_of(t.ticks, t.by_venue, 1800.0).join(last, ["venue", "ts"], "left")


@query("c3_forward_backward_fill", FILLED + """
SELECT venue, epoch_us(ts) AS ts, coalesce(last_value(price IGNORE NULLS) OVER w, 0) AS fwd,
  first_value(price IGNORE NULLS) OVER (PARTITION BY venue ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bwd,
  coalesce(volume, 0) AS volume FROM j WINDOW w AS (PARTITION BY venue ORDER BY ts)""")
def fills_both(t):
    d = gappy(t).withColumn("fwd", F.col("price")).withColumn("bwd", F.col("price"))
    d = B.fill(d, TB, ["fwd"], "ffill", zero=["volume"])
    return B.fill(d, TB, ["bwd"], "bfill").select("venue", us("ts"), "fwd", "bwd", "volume")


@query("c4_time_interpolation", FILLED + """,
p AS (SELECT venue, ts, price,
  last_value(CASE WHEN price IS NOT NULL THEN ts END IGNORE NULLS) OVER a AS t0, last_value(price IGNORE NULLS) OVER a AS p0,
  first_value(CASE WHEN price IS NOT NULL THEN ts END IGNORE NULLS) OVER z AS t1, first_value(price IGNORE NULLS) OVER z AS p1
  FROM j WINDOW a AS (PARTITION BY venue ORDER BY ts),
  z AS (PARTITION BY venue ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT venue, epoch_us(ts) AS ts, round(CASE WHEN price IS NOT NULL THEN price WHEN p1 IS NULL THEN p0 WHEN p0 IS NULL THEN p1
  ELSE p0 + (p1 - p0) * (epoch_us(ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0)) END, 6) AS price FROM p""")
def interp(t):
    return B.interpolate(gappy(t), TB, ["price"]).select("venue", us("ts"), *r("price"))


L1 = """
b AS (SELECT symbol, time_bucket(INTERVAL '1 day', ts) AS ts, arg_max(price, ts) AS p, arg_max(volume, ts) AS s
  FROM ticks GROUP BY 1, 2),
g AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL '1 day')) AS ts FROM b GROUP BY symbol),
l1 AS (SELECT symbol, ts, last_value(p IGNORE NULLS) OVER w AS mid_price, last_value(s IGNORE NULLS) OVER w AS last_size
  FROM g LEFT JOIN b USING (symbol, ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


@query("c5_ticks_to_l1", "WITH " + L1 + " SELECT symbol, epoch_us(ts) AS ts, mid_price, last_size FROM l1")
def l1(t):
    return B.ticks_to_l1(t.ticks, t.by_symbol, DAY).select("symbol", us("ts"), "mid_price", "last_size")


@query("c6_l1_to_ohlcv", "WITH " + L1 + """ SELECT symbol, epoch_us(time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01')) AS bucket,
  arg_min(mid_price, ts) AS open, max(mid_price) AS high, min(mid_price) AS low, arg_max(mid_price, ts) AS close,
  sum(last_size) AS volume FROM l1 GROUP BY 1, 2""")
def l1_bars(t):
    snaps = B.ticks_to_l1(t.ticks, t.by_symbol, DAY)
    out = B.ohlcv(snaps, Axis(("symbol",), "ts"), 7 * DAY, price="mid_price", volume="last_size")
    return out.select("symbol", us("bucket"), "open", "high", "low", "close", "volume")


@query("c6_ohlcv_bars", """
SELECT symbol, venue, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS bucket, arg_min(price, ts) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, ts) AS close, sum(volume) AS volume, count(*) AS trade_count FROM ticks GROUP BY 1, 2, 3""")
def ohlcv(t):
    return B.ohlcv(t.ticks, t.by_series, HOUR).select(
        "symbol", "venue", us("bucket"), "open", "high", "low", "close", "volume", "trade_count")


@query("c7_align_timeframes", """
WITH a AS (SELECT DISTINCT venue, time_bucket(INTERVAL '1 hour', ts) AS ts FROM ticks),
s AS (SELECT venue, time_bucket(INTERVAL '4 hours', ts) AS ts, arg_max(price, ts) AS slow FROM ticks GROUP BY 1, 2)
SELECT a.venue, epoch_us(a.ts) AS ts, s.slow FROM a ASOF LEFT JOIN s ON a.venue = s.venue AND a.ts >= s.ts""")
def align(t):
    from tickloom.operators.joins import asof
    axis = t.ticks.select("venue", F.window("ts", "1 hour").start.alias("ts")).distinct()
    slow = B.ohlcv(t.ticks, t.by_venue, 4 * HOUR).select("venue", F.col("bucket").alias("ts"), F.col("close").alias("slow"))
    return asof(axis, slow, keys=["venue"], values=["slow"], grain=DAY).select("venue", us("ts"), "slow")


@query("c8_order_book_resample", """
WITH lv AS (SELECT venue, time_bucket(INTERVAL '2 hours', ts) AS ts, avg(price) AS b0, avg(price * 0.5) AS b1,
  avg(volume) AS a0, avg(volume * 0.25) AS a1 FROM ticks GROUP BY 1, 2),
g AS (SELECT venue, unnest(generate_series(min(ts), max(ts), INTERVAL '2 hours')) AS ts FROM lv GROUP BY venue),
j AS (SELECT venue, ts, b0, b1, a0, a1, coalesce(b0, 0) + coalesce(b1, 0) AS b, coalesce(a0, 0) + coalesce(a1, 0) AS a
  FROM g LEFT JOIN lv USING (venue, ts)),
m AS (SELECT *, (b0 * a + a0 * b) / nullif(a + b, 0) AS mp FROM j)
SELECT venue, epoch_us(ts) AS ts, round(b0, 6) AS b0, round(b1, 6) AS b1, round(a0, 6) AS a0, round(a1, 6) AS a1,
  round(coalesce((b - a) / nullif(a + b, 0), 0), 6) AS imbalance,
  round(coalesce(last_value(mp IGNORE NULLS) OVER w, first_value(mp IGNORE NULLS) OVER z), 6) AS microprice
FROM m WINDOW w AS (PARTITION BY venue ORDER BY ts),
  z AS (PARTITION BY venue ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def book(t):
    levels = t.ticks.select("venue", "ts", F.col("price").alias("b0"), (F.col("price") * 0.5).alias("b1"),
                            F.col("volume").alias("a0"), (F.col("volume") * 0.25).alias("a1"))
    out = B.book_resample(levels, TB, 2 * HOUR, ["b0", "b1"], ["a0", "a1"])
    return out.select("venue", us("ts"), *r("b0", "b1", "a0", "a1", "imbalance", "microprice"))


NORM = """
u AS (SELECT symbol, ts, arg_max(price, seq) AS price, arg_max(volume, seq) AS volume FROM ticks GROUP BY 1, 2),
b AS (SELECT symbol, time_bucket(INTERVAL '6 hours', ts) AS ts, arg_max(price, ts) AS close, sum(volume) AS volume
  FROM u GROUP BY 1, 2),
g AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL '6 hours')) AS ts FROM b GROUP BY symbol),
n AS (SELECT symbol, ts, b.close IS NULL AS missing, last_value(b.close IGNORE NULLS) OVER w AS close,
  coalesce(b.volume, 0) AS volume FROM g LEFT JOIN b USING (symbol, ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


@query("c9_normalize_market_data", "WITH " + NORM + """
SELECT symbol, epoch_us(ts) AS ts, close AS open, close AS high, close AS low, close, volume, missing FROM n""")
def normalize(t):
    return B.normalize_market(t.ticks, t.by_symbol, 6 * HOUR).select(
        "symbol", us("ts"), "open", "high", "low", "close", "volume", "missing")


DAILY = """
d AS (SELECT symbol, time_bucket(INTERVAL '1 day', ts) AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, sum(volume) AS volume FROM ticks GROUP BY 1, 2),
g AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL '1 day')) AS ts FROM d GROUP BY 1), x AS (SELECT g.symbol, g.ts, open, high, low, close, d.volume, d.close IS NULL AS missing FROM g LEFT JOIN d USING (symbol, ts))"""
PRICES = ("open", "high", "low", "close")
FILLED = {
    "none": ", ".join(PRICES) + ", volume",
    "bfill": ", ".join(f"first_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}" for c in PRICES) + ", coalesce(volume, 0) AS volume",
    "interpolate": ", ".join(f"""round(coalesce({c}, last_value({c} IGNORE NULLS) OVER w + (first_value({c} IGNORE NULLS) OVER f - last_value({c} IGNORE NULLS) OVER w)
      * date_diff('day', last_value(CASE WHEN {c} IS NOT NULL THEN ts END IGNORE NULLS) OVER w, ts)
      / date_diff('day', last_value(CASE WHEN {c} IS NOT NULL THEN ts END IGNORE NULLS) OVER w, first_value(CASE WHEN {c} IS NOT NULL THEN ts END IGNORE NULLS) OVER f)), 6) AS {c}""" for c in PRICES) + ", coalesce(volume, 0) AS volume"}


def daily(t, axis):
    return B.ohlcv(t.ticks, axis, 24 * HOUR).withColumnRenamed("bucket", "ts")


for _method, _sql in FILLED.items():
    @query(f"c9_normalize_ohlcv_{_method}", f"""WITH {DAILY} SELECT symbol, epoch_us(ts) AS ts, {_sql}, missing FROM x
WINDOW w AS (PARTITION BY symbol ORDER BY ts), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
    def normalize_ohlcv(t, method=_method):
        done = B.normalize_market(daily(t, t.by_symbol), Axis(("symbol",), "ts"), 24 * HOUR, kind="ohlcv", method=method)
        prices = [F.round(c, 6).alias(c) if method == "interpolate" else F.col(c) for c in PRICES]
        return done.select("symbol", us("ts"), *prices, "volume", "missing")


@query("c9_inferred_cadence", """
WITH d AS (SELECT coalesce(venue, symbol) AS name, time_bucket(INTERVAL '1 day', ts) AS ts, arg_max(price, (ts, seq)) AS price, sum(volume) AS volume FROM ticks GROUP BY GROUPING SETS ((venue, time_bucket(INTERVAL '1 day', ts)), (symbol, time_bucket(INTERVAL '1 day', ts)))),
s AS (SELECT name FROM (SELECT name, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY name ORDER BY ts)) AS step FROM d) GROUP BY name HAVING min(step) = max(step) AND count(*) >= 3),
p AS (SELECT name, ts, CASE WHEN day(ts) % 7 <> 3 THEN price END AS close, volume FROM d JOIN s USING (name)), e AS (SELECT name, min(ts) AS lo, max(ts) AS hi FROM p WHERE close IS NOT NULL GROUP BY name)
SELECT name, epoch_us(ts) AS ts, last_value(close IGNORE NULLS) OVER (PARTITION BY name ORDER BY ts) AS close, CASE WHEN close IS NULL THEN 0 ELSE volume END AS volume, close IS NULL AS missing FROM p JOIN e USING (name) WHERE ts BETWEEN lo AND hi""")
def inferred_cadence(t):
    """Daily closes of venues (every day) and symbols (with holes, so most have no cadence), every seventh day without a price."""
    both = [daily(t, axis).select(F.col(axis.keys[0]).alias("name"), "ts", "close", "volume") for axis in (t.by_venue, t.by_symbol)]
    rows = both[0].unionByName(both[1]).withColumn("price", F.when(F.dayofmonth("ts") % 7 != 3, F.col("close")))
    return B.normalize_market(rows, Axis(("name",), "ts"), None).select("name", us("ts"), "close", "volume", "missing")


@query("c9_normalize_report", "WITH " + NORM + """
SELECT symbol, count(*) AS rows, epoch_us(min(n.ts)) AS start, epoch_us(max(n.ts)) AS "end",
  count(*) FILTER (WHERE missing) AS missing_intervals, count(*) FILTER (WHERE missing) AS filled_intervals,
  (SELECT count(*) - count(DISTINCT ts) FROM ticks k WHERE k.symbol = n.symbol) AS duplicates_dropped
FROM n GROUP BY symbol""")
def normalize_report(t):
    done = B.normalize_market(t.ticks, t.by_symbol, 6 * HOUR)
    return B.normalization_report(t.ticks, done, t.by_symbol).select(
        "symbol", "rows", us("start"), us("end"), "missing_intervals", "filled_intervals", "duplicates_dropped")


@query("c10_infer_frequency", """
WITH b AS (SELECT DISTINCT symbol, time_bucket(INTERVAL '1 day', ts) AS ts FROM ticks),
d AS (SELECT symbol, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS d FROM b)
SELECT symbol, CAST(CASE WHEN min(d) = max(d) THEN min(d) END AS DOUBLE) AS step_us, count(*) AS rows FROM d GROUP BY symbol""")
def infer(t):
    days = t.ticks.select("symbol", F.window("ts", "1 day").start.alias("ts")).distinct()
    return B.infer_step(days, Axis(("symbol",), "ts", (), grain=DAY)).withColumn("step_us", F.col("step_us").cast("double"))


@query("c11_ohlcv_range_query", """
SELECT epoch_us(time_bucket(INTERVAL '1 minute', ts)) AS bucket, symbol, arg_min(price, ts) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, ts) AS close, sum(volume) AS volume
FROM ticks WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND venue = 'purchase'
GROUP BY 1, 2 ORDER BY 1, 2""")
def bars_range(t):
    return B.bars_query(t.ticks, t.by_symbol, 60.0, start="2024-01-05", end="2024-01-20", where={"venue": "purchase"}).select(
        us("bucket"), "symbol", "open", "high", "low", "close", "volume")


@query("c12_minute_rollup", """
SELECT symbol, venue, epoch_us(time_bucket(INTERVAL '1 minute', ts)) AS bucket, arg_min(price, ts) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, ts) AS close, sum(volume) AS volume, count(*) AS trade_count,
  epoch_us(min(ts)) AS first_ts, epoch_us(max(ts)) AS last_ts FROM ticks GROUP BY 1, 2, 3""")
def minute(t):
    return B.ohlcv(t.ticks, t.by_series, 60.0).select(
        "symbol", "venue", us("bucket"), "open", "high", "low", "close", "volume", "trade_count", us("first_ts"), us("last_ts"))


@query("c13_rollup_of_rollup", """
SELECT venue, epoch_us(time_bucket(INTERVAL '1 day', ts)) AS bucket, arg_min(price, ts) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, ts) AS close, sum(volume) AS volume, count(*) AS trade_count FROM ticks GROUP BY 1, 2""")
def rollup2(t):
    assert B.stored_bar_for(DAY, [60.0, HOUR, 7 * HOUR]) == HOUR
    fine = B.ohlcv(t.ticks, t.by_venue, HOUR)
    return B.rebar(fine, ["venue"], DAY).select(
        "venue", us("bucket"), "open", "high", "low", "close", "volume", "trade_count")


_MT = " UNION ALL ".join(f"""(SELECT venue, '{n}' AS timeframe, ts AS bucket, last_value(p IGNORE NULLS) OVER (PARTITION BY venue ORDER BY ts) AS price
 FROM (SELECT venue, unnest(generate_series(min(time_bucket(INTERVAL '{i}', ts)), max(time_bucket(INTERVAL '{i}', ts)), INTERVAL '{i}')) AS ts
   FROM ticks GROUP BY venue) g LEFT JOIN (SELECT venue, time_bucket(INTERVAL '{i}', ts) AS ts, arg_max(price, ts) AS p FROM ticks GROUP BY 1, 2) b
 USING (venue, ts))""" for n, i in (("5m", "5 minutes"), ("15m", "15 minutes"), ("1h", "1 hour")))


@query("c14_multi_timeframe", f"SELECT venue, timeframe, epoch_us(bucket) AS bucket, price FROM ({_MT})")
def frames(t):
    return B.multi_timeframe(t.ticks, t.by_venue, {"5m": 300.0, "15m": 900.0, "1h": HOUR}).select(
        "venue", "timeframe", us("bucket"), "price")


@query("c15_sliding_windows", """
SELECT vec_id, start, round(list_sum(v), 6) AS total, round(v[1], 6) AS head, len(v) AS width FROM (
  SELECT vec_id, pos - 7 AS start, list(x) OVER (PARTITION BY vec_id ORDER BY pos ROWS 7 PRECEDING) AS v FROM multi_series)
WHERE start >= 0 AND start % 4 = 0""")
def sliding(t):
    out = B.sliding_windows(t.multi_series, t.by_vec, "x", 8, 4)
    return out.select("vec_id", "start", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
                      F.round(F.col("values")[0], 6).alias("head"), F.size("values").cast("long").alias("width"))


def conv_sql(mode):
    if mode == "same":
        expr = "coalesce(lead(x) OVER w, 0) * 0.25 + x * 0.5 + coalesce(lag(x) OVER w, 0) * 0.25"
        return f"SELECT vec_id, pos, round({expr}, 6) AS conv FROM multi_series WINDOW w AS (PARTITION BY vec_id ORDER BY pos)"
    base = "multi_series" if mode == "valid" else """(SELECT * FROM multi_series UNION ALL
      SELECT vec_id, m + i, NULL FROM (SELECT vec_id, max(pos) AS m FROM multi_series GROUP BY 1), (VALUES (1), (2)) v(i))"""
    expr = "coalesce(x, 0) * 0.25 + coalesce(lag(x) OVER w, 0) * 0.5 + coalesce(lag(x, 2) OVER w, 0) * 0.25"
    sql = f"SELECT vec_id, pos, round({expr}, 6) AS conv FROM {base} WINDOW w AS (PARTITION BY vec_id ORDER BY pos)"
    return f"SELECT * FROM ({sql}) WHERE pos >= 2" if mode == "valid" else sql


for _mode in ("same", "full", "valid"):
    @query(f"c16_convolution_{_mode}", conv_sql(_mode))
    def conv(t, mode=_mode):
        series = t.multi_series.withColumn("at", F.col("pos"))
        axis = Axis(("vec_id",), "at", (), grain=1024.0, numeric=True)
        return B.convolve(series.select("vec_id", "at", "x"), axis, "x", [0.25, 0.5, 0.25], mode).select(
            "vec_id", "pos", F.round("conv", 6).alias("conv"))
