"""Sessions and time functions over the span of the event ticks."""

from pyspark.sql import functions as F

from tickloom.functions.exprs import micros
from tickloom.operators import calendar as K
from tickloom.plans.quality import NYSE, session_table
from tickloom.plans.registry import query

NIGHT = K.Market("XNIT", "Europe/London", {d: ("18:00:00", "02:00:00") for d in range(5)}, holidays=("2024-01-01",))


def us(c, name=None):
    return micros(c).alias(name or c)


SPAN = "b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM ticks), d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS d)"
SES = SPAN + """,
n AS (SELECT 'XNYS' AS market, d, epoch_us(timezone('America/New_York', d + TIME '09:30:00')) AS o,
  epoch_us(timezone('America/New_York', d + CASE WHEN d = DATE '2024-01-26' THEN TIME '13:00:00' ELSE TIME '16:00:00' END)) AS c FROM d
  WHERE isodow(d) < 6 AND d NOT IN (DATE '2024-01-01', DATE '2024-01-15')
  UNION ALL SELECT 'XNIT', d, epoch_us(timezone('Europe/London', d + TIME '18:00:00')), epoch_us(timezone('Europe/London', (d + 1) + TIME '02:00:00')) FROM d
  WHERE isodow(d) < 6 AND d <> DATE '2024-01-01'),
s AS (SELECT n.* FROM n, b WHERE c >= epoch_us(lo) AND o <= epoch_us(hi))"""


def both(t):
    return session_table(t, NYSE, NIGHT)


@query("k1_sessions", "WITH " + SES + " SELECT market, CAST(d AS VARCHAR) AS session_date, o AS open_ts, c AS close_ts FROM s")
def sessions(t):
    return both(t).select("market", F.col("session_date").cast("string").alias("session_date"), us("open_ts"), us("close_ts"))


def placed(t):
    return t.ticks.select("seq", "ts", F.when(F.col("seq") % 2 == 0, "XNYS").otherwise("XNIT").alias("market"))


@query("k2_is_market_open", "WITH " + SES + """
SELECT seq, coalesce(epoch_us(ts) >= o AND epoch_us(ts) < c, false) AS is_open FROM (SELECT seq, ts, CASE WHEN seq % 2 = 0 THEN 'XNYS' ELSE 'XNIT' END AS market,
  CAST(timezone(CASE WHEN seq % 2 = 0 THEN 'America/New_York' ELSE 'Europe/London' END, timezone('UTC', ts)) AS DATE) AS d FROM ticks) LEFT JOIN s USING (market, d)""")
def is_open(t):
    return K.with_open_flag(placed(t), both(t)).select("seq", "is_open")


@query("k3_next_open_previous_close", "WITH " + SES + """,
p AS (SELECT seq, epoch_us(ts) AS ts, CASE WHEN seq % 2 = 0 THEN 'XNYS' ELSE 'XNIT' END AS market FROM ticks)
SELECT seq, CAST(a.o AS DOUBLE) AS next_open, CAST(z.c AS DOUBLE) AS previous_close FROM p ASOF LEFT JOIN s a ON p.market = a.market AND p.ts < a.o
ASOF LEFT JOIN s z ON p.market = z.market AND p.ts >= z.o""")
def around(t):
    d = K.previous_close(K.next_open(placed(t), both(t)), both(t))
    return d.select("seq", us("next_open").cast("double").alias("next_open"), us("previous_close").cast("double").alias("previous_close"))


@query("k4_session_events", "WITH " + SES + " SELECT market, 'open' AS kind, o AS ts FROM s UNION ALL SELECT market, 'close', c FROM s")
def events(t):
    return K.session_events(both(t)).select("market", "kind", us("ts"))


def windows_sql(cond):
    return "WITH " + SES + f""",
e AS (SELECT least(greatest(o, epoch_us(lo)), epoch_us(hi)) AS x, 1 AS d FROM s, b UNION ALL SELECT least(greatest(c, epoch_us(lo)), epoch_us(hi)), -1 FROM s, b),
p AS (SELECT x, sum(d) AS d FROM e GROUP BY x),
w AS (SELECT x, coalesce(lead(x) OVER (ORDER BY x), (SELECT epoch_us(hi) FROM b)) AS until, sum(d) OVER (ORDER BY x) AS k FROM p)
SELECT x AS window_start, until AS window_end, CAST(k AS BIGINT) AS open_markets FROM w WHERE {cond} AND x < until"""


@query("k5_trading_windows_union", windows_sql("k >= 1"))
def windows_union(t):
    return K.trading_windows(both(t), K.span_of(t.ticks, "ts")).select(us("window_start"), us("window_end"), "open_markets")


@query("k5_trading_windows_intersection", windows_sql("k >= 2"))
def windows_all(t):
    return K.trading_windows(both(t), K.span_of(t.ticks, "ts"), "intersection", 2).select(us("window_start"), us("window_end"), "open_markets")


@query("k6_time_conversion", """
SELECT seq, strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') AS ny,
  strftime(timezone('Asia/Tokyo', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') AS tokyo, epoch_us(ts) // 1000000 AS s FROM ticks""")
def convert(t):
    fmt = "yyyy-MM-dd HH:mm:ss"
    return t.ticks.select("seq", F.date_format(K.to_zone(F.col("ts"), "America/New_York"), fmt).alias("ny"),
                          F.date_format(K.to_zone(F.col("ts"), "Asia/Tokyo"), fmt).alias("tokyo"), F.unix_seconds("ts").alias("s"))


@query("k7_bucket_floor", "SELECT seq, epoch_us(ts) // 300000000 * 300 AS bucket FROM ticks")
def floor(t):
    return t.ticks.select("seq", K.bucket_floor("ts", 300.0).alias("bucket"))


@query("c2_session_grid", "WITH " + SES + """ SELECT market, CAST(d AS VARCHAR) AS session_date, unnest(generate_series(o, c - 1, 420000000)) AS ts FROM s""")
def session_grid(t):
    return K.session_grid(both(t), 420.0).select("market", F.col("session_date").cast("string").alias("session_date"), us("ts"))
