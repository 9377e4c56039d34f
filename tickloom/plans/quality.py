"""Quality gates, gaps, backfill plans, parity and retention."""

from pyspark.sql import functions as F

from tickloom.functions.exprs import micros
from tickloom.operators import bars as B
from tickloom.operators import calendar as K
from tickloom.operators import gaps as G
from tickloom.operators import parity as PA
from tickloom.operators import quality as Q
from tickloom.operators.axis import Axis
from tickloom.plans.registry import query
from tickloom.session import scratch_dir
from tickloom.sources import files as S

HOUR, DAY = 3600.0, 86400.0


def us(c, name=None):
    return micros(c).alias(name or c)


Z = """avg(price) OVER p AS m, nullif(stddev_pop(price) OVER p, 0) AS s, count(price) OVER p AS c"""
PREV = "WINDOW p AS (PARTITION BY venue ORDER BY ts, seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query("q1_prior_zscore", f"""
SELECT venue, seq, round(CASE WHEN c = 20 THEN (price - m) / s END, 6) AS z FROM (SELECT *, {Z} FROM ticks {PREV})""")
def prior_z(t):
    return Q.prior_zscore(t.ticks, t.by_venue, "price", 20).select("venue", "seq", F.round("z", 6).alias("z"))


# Fills per part and day: several fills share a day, so duplicates occur.
DUP_AXIS = Axis(("part",), "ts", ("order_id", "line", "broker"), grain=DAY)
JUDGED = """
n AS (SELECT part, ts, order_id, line, broker, quantity, count(*) OVER (PARTITION BY part, ts) AS copies,
  row_number() OVER (PARTITION BY part, ts ORDER BY order_id, line, broker) AS k FROM fills),
z AS (SELECT *, avg(quantity) OVER p AS m, nullif(stddev_pop(quantity) OVER p, 0) AS s, count(*) OVER p AS c FROM n WHERE k = 1
  WINDOW p AS (PARTITION BY part ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
v AS (SELECT part, ts, order_id, line, broker, quantity,
    CASE WHEN c = 5 AND abs((quantity - m) / s) > 2 THEN 'spike' ELSE 'clean' END AS verdict FROM z
  UNION ALL SELECT part, ts, order_id, line, broker, quantity, 'duplicate' FROM n WHERE copies > 1)"""


@query("q2_quarantine", "WITH " + JUDGED + " SELECT part, epoch_us(ts) AS ts, order_id, line, verdict FROM v")
def quarantine(t):
    d = t.fills.select("part", "ts", "order_id", "line", "broker", "quantity")
    return Q.quarantine(d, DUP_AXIS, "quantity", threshold=2.0, window=5).select("part", us("ts"), "order_id", "line", "verdict")


@query("q3_range_checks", """
SELECT seq, concat_ws(',', CASE WHEN price < 5 OR price >= 200 THEN 'price' END, CASE WHEN volume <= 2 OR volume > 95 THEN 'volume' END)
AS range_violations FROM ticks""")
def ranges(t):
    checks = {"price": {"min": 5.0, "max": 200.0, "inclusive_max": False}, "volume": {"min": 2.0, "max": 95.0, "inclusive_min": False}}
    return Q.range_checks(t.ticks, checks).select("seq", F.array_join("range_violations", ",").alias("range_violations"))


@query("q4_temporal_contract", """
SELECT symbol, epoch_us(min(ts)) AS first_ts, epoch_us(max(ts)) AS last_ts, concat_ws(',',
  CASE WHEN min(ts) < TIMESTAMP '2024-01-01 06:00:00' THEN 'earliest' END, CASE WHEN max(ts) > TIMESTAMP '2024-01-30 20:00:00' THEN 'latest' END,
  CASE WHEN abs(epoch_us(min(ts)) - epoch_us(TIMESTAMP '2024-01-01')) > 43200000000 THEN 'expected_start' END,
  CASE WHEN epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts)) > 86400000000 THEN 'max_lag' END) AS breaches FROM ticks GROUP BY symbol""")
def contract(t):
    out = Q.temporal_contract(t.ticks, ["symbol"], "ts", earliest="2024-01-01 06:00:00", latest="2024-01-30 20:00:00",
                              expected_start="2024-01-01", tolerance=43200.0, max_lag=DAY, as_of="2024-01-31")
    return out.select("symbol", us("first_ts"), us("last_ts"), F.array_join("breaches", ",").alias("breaches"))


@query("q5_quality_gate", "WITH " + JUDGED + """,
g AS (SELECT *, quantity >= 49 AS oor FROM v),
r AS (SELECT part, count(*) FILTER (WHERE verdict <> 'duplicate') AS rows, count(*) FILTER (WHERE verdict = 'clean' AND NOT oor) AS clean,
  count(*) FILTER (WHERE verdict = 'spike') AS spikes, count(*) FILTER (WHERE verdict = 'duplicate') AS duplicates,
  count(*) FILTER (WHERE verdict <> 'duplicate' AND oor) AS range_violations, min(ts) < TIMESTAMP '1995-02-01' AS early FROM g GROUP BY part)
SELECT part, rows, clean, spikes, duplicates, range_violations, CASE WHEN early THEN 'earliest' ELSE '' END AS breaches,
  (early OR range_violations > 0 OR (spikes + duplicates) / greatest(rows, 1) > 0.15) AS blocked FROM r""")
def gate(t):
    d = t.fills.select("part", "ts", "order_id", "line", "broker", "quantity")
    out = Q.quality_gate(d, DUP_AXIS, "quantity", threshold=2.0, window=5, checks={"quantity": {"max": 49.0, "inclusive_max": False}},
                         contract={"earliest": "1995-02-01"}, max_fraction=0.15)
    return out.withColumn("breaches", F.array_join("breaches", ","))


@query("q6_series_schema", """
WITH b AS (SELECT symbol, time_bucket(INTERVAL '1 day', ts) AS ts, CASE WHEN max(price) > 400 THEN NULL ELSE max(price) END AS price FROM ticks GROUP BY 1, 2),
s AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts)) AS gap FROM b)
SELECT symbol, count(*) AS rows, CAST(0 AS BIGINT) AS repeated, count(*) FILTER (WHERE gap <> 86400000000) AS off_cadence,
  count(*) FILTER (WHERE price IS NULL) AS bad_values, CAST(1 AS BIGINT) AS extra_columns, false AS valid FROM s GROUP BY symbol""")
def schema(t):
    b = t.ticks.groupBy("symbol", F.window("ts", "1 day").start.alias("ts")).agg(F.max("price").alias("price"))
    b = b.withColumn("price", F.when(F.col("price") <= 400, F.col("price"))).withColumn("stray", F.lit(1))
    return Q.series_schema(b, Axis(("symbol",), "ts", (), grain=DAY), ["price"], step=DAY)


@query("q7_model_constraints", """
SELECT symbol, epoch_us(bucket) AS bucket, concat_ws(',', CASE WHEN low > least(open, close) THEN 'low_above_body' END,
  CASE WHEN high < greatest(open, close) THEN 'high_below_body' END, CASE WHEN high < low THEN 'high_below_low' END) AS broken
FROM (SELECT symbol, time_bucket(INTERVAL '1 day', ts) AS bucket, arg_min(price, ts) AS open, max(price) * 0.99 AS high,
  min(price) * 1.01 AS low, arg_max(price, ts) AS close FROM ticks GROUP BY 1, 2)""")
def bar_rules(t):
    b = B.ohlcv(t.ticks, t.by_symbol, DAY).withColumn("high", F.col("high") * 0.99).withColumn("low", F.col("low") * 1.01)
    return b.select("symbol", us("bucket"), F.array_join(Q.bar_rules(), ",").alias("broken"))


@query("q7_tick_constraints", """
SELECT seq, concat_ws(',', CASE WHEN price IS NULL THEN 'price_not_finite' END, CASE WHEN price < 0 THEN 'price_negative' END,
  CASE WHEN volume > 1e12 THEN 'volume_too_large' END) AS broken FROM (SELECT seq,
  CASE WHEN seq % 11 = 0 THEN NULL WHEN seq % 7 = 0 THEN -price ELSE price END AS price, CASE WHEN seq % 13 = 0 THEN 2e12 ELSE volume END AS volume FROM ticks)""")
def tick_rules(t):
    s = F.col("seq")
    d = t.ticks.withColumn("price", F.when(s % 11 == 0, F.lit(None)).when(s % 7 == 0, -F.col("price")).otherwise(F.col("price"))).withColumn(
        "volume", F.when(s % 13 == 0, 2e12).otherwise(F.col("volume")))
    return d.select("seq", F.array_join(Q.tick_rules(), ",").alias("broken"))


@query("q8_tick_integrity", """
SELECT venue, count(*) AS rows, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS off_cadence,
  count(*) FILTER (WHERE seq % 9 = 0) AS bad_values, CAST(0 AS BIGINT) AS extra_columns, false AS valid FROM ticks GROUP BY venue""")
def integrity(t):
    d = t.ticks.select("venue", "ts", "seq", F.when(F.col("seq") % 9 != 0, F.col("price")).otherwise(F.lit(float("nan"))).alias("price"))
    return Q.series_schema(d, t.by_venue, ["price"], step=None)


WEEK = {d: ("09:30:00", "16:00:00") for d in range(5)}
NYSE = K.Market("XNYS", "America/New_York", WEEK, holidays=("2024-01-01", "2024-01-15"), special={"2024-01-26": ("09:30:00", "13:00:00")})


def session_table(t, *markets):
    return K.sessions(K.span_of(t.ticks, "ts"), list(markets) or [NYSE])


@query("q9_calendar_alignment", """
WITH d AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-31', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS d),
s AS (SELECT epoch_us(timezone('America/New_York', d + TIME '09:30:00')) AS o,
  epoch_us(timezone('America/New_York', d + CASE WHEN d = DATE '2024-01-26' THEN TIME '13:00:00' ELSE TIME '16:00:00' END)) AS c FROM d
  WHERE isodow(d) < 6 AND d NOT IN (DATE '2024-01-01', DATE '2024-01-15')),
g AS (SELECT unnest(generate_series(o, c - 1, 1800000000)) AS t FROM s WHERE o <= (SELECT epoch_us(max(ts)) FROM ticks)
  AND c >= (SELECT epoch_us(min(ts)) FROM ticks)),
e AS (SELECT v.venue, g.t FROM g, (SELECT DISTINCT venue FROM ticks) v),
p AS (SELECT DISTINCT venue, epoch_us(time_bucket(INTERVAL '30 minutes', ts)) AS t FROM ticks)
SELECT venue, count(*) FILTER (WHERE p.venue IS NULL) AS missing, count(*) FILTER (WHERE e.venue IS NULL) AS extra, CAST(0 AS BIGINT) AS repeated,
  false AS aligned FROM (SELECT venue, t, e, p FROM e FULL JOIN p USING (venue, t)) GROUP BY venue""")
def alignment(t):
    grid = K.session_grid(session_table(t), 1800.0).select("ts").crossJoin(t.ticks.select("venue").distinct())
    have = t.ticks.select("venue", F.window("ts", "30 minutes").start.alias("ts")).distinct()
    return K.alignment(have, grid, ["venue"])


H = """h AS (SELECT DISTINCT venue, time_bucket(INTERVAL '1 hour', ts) AS ts FROM ticks),
g AS (SELECT venue, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT venue FROM h)),
m AS (SELECT g.venue, g.ts FROM g ANTI JOIN h USING (venue, ts)),
i AS (SELECT *, epoch(ts) / 3600 - row_number() OVER (PARTITION BY venue ORDER BY ts) AS island FROM m),
gaps AS (SELECT venue, min(ts) AS gap_start, max(ts) + INTERVAL 1 HOUR AS gap_end, count(*) AS missing FROM i GROUP BY venue, island)"""
VH = Axis(("venue",), "ts", (), grain=DAY)


def hours(t):
    have = t.ticks.select("venue", F.window("ts", "1 hour").start.alias("ts")).distinct()
    bounds = t.ticks.select("venue").distinct().select(
        "venue", F.lit("2024-01-01").cast("timestamp").alias("start"), F.lit("2024-01-31").cast("timestamp").alias("end"))
    return have, bounds


@query("q10_gap_detection", "WITH " + H + " SELECT venue, epoch_us(gap_start) AS gap_start, epoch_us(gap_end) AS gap_end, missing FROM gaps")
def gap_detection(t):
    return G.gaps(*hours(t), VH, HOUR).select("venue", us("gap_start"), us("gap_end"), "missing")


@query("q11_backfill_plan", "WITH " + H + """ SELECT venue, epoch_us(gap_start) AS gap_start, epoch_us(gap_end) AS gap_end, missing,
  epoch_us(a) AS covered_from, epoch_us(b) AS covered_to FROM gaps JOIN (SELECT venue, min(ts) AS a, max(ts) AS b FROM h GROUP BY 1) USING (venue)""")
def plan(t):
    return G.backfill_plan(*hours(t), VH, HOUR).select(
        "venue", us("gap_start"), us("gap_end"), "missing", us("covered_from"), us("covered_to"))


@query("q12_gap_segments", "WITH " + H + """,
n AS (SELECT *, row_number() OVER (PARTITION BY venue, island ORDER BY ts) - 1 AS k, min(ts) OVER (PARTITION BY venue, island) AS gap_start FROM i)
SELECT venue, epoch_us(gap_start) AS gap_start, epoch_us(min(ts)) AS seg_start, epoch_us(max(ts) + INTERVAL 1 HOUR) AS seg_end FROM n
GROUP BY venue, gap_start, k // 2""")
def segs(t):
    return G.segments(G.gaps(*hours(t), VH, HOUR), ["venue"], HOUR, 2).select("venue", us("gap_start"), us("seg_start"), us("seg_end"))


@query("q13_payload_validation", """
WITH h AS (SELECT venue, time_bucket(INTERVAL '1 hour', ts) AS ts, count(*) AS n FROM ticks GROUP BY 1, 2),
g AS (SELECT venue, unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-29', INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT venue FROM h))
SELECT venue, count(*) FILTER (WHERE n IS NULL) AS missing, count(*) FILTER (WHERE gv IS NULL) AS unexpected, count(*) FILTER (WHERE n > 1) AS repeated
FROM (SELECT venue, ts, g.venue AS gv, n FROM g FULL JOIN h USING (venue, ts)) GROUP BY venue""")
def payload(t):
    have = t.ticks.select("venue", F.window("ts", "1 hour").start.alias("ts"))
    bounds = t.ticks.select("venue").distinct().select(
        "venue", F.lit("2024-01-02").cast("timestamp").alias("a"), F.lit("2024-01-29").cast("timestamp").alias("b"))
    return G.payload_check(have, B.time_grid(bounds, ["venue"], "a", "b", HOUR), ["venue"], "ts")


@query("q14_synchronise_layers", "WITH " + H + """,
b AS (SELECT venue, time_bucket(INTERVAL '1 hour', ts) AS ts, max(price) AS price, min(seq) AS s FROM ticks GROUP BY 1, 2),
k AS (SELECT venue, ts, price + CASE WHEN s % 3 = 0 THEN 2 WHEN s % 2 = 0 THEN 1 ELSE 0 END AS price, 0 AS fetched FROM b WHERE s % 5 > 0)
SELECT venue, epoch_us(ts) AS ts, price, CAST(fetched AS BIGINT) AS fetched FROM k
UNION ALL SELECT venue, epoch_us(ts), price + 9, CAST(1 AS BIGINT) FROM b WHERE s % 5 = 0""")
def sync(t):
    b = t.ticks.groupBy("venue", F.window("ts", "1 hour").start.alias("ts")).agg(F.max("price").alias("price"), F.min("seq").alias("s"))
    layer = lambda cond, add: b.filter((F.col("s") % 5 > 0) & cond).select("venue", "ts", (F.col("price") + add).alias("price"))
    cache, hist, live = layer(F.lit(True), 0), layer(F.col("s") % 2 == 0, 1), layer(F.col("s") % 3 == 0, 2)
    source = b.select("venue", "ts", (F.col("price") + 9).alias("price"))
    out = G.synchronise(cache, hist, live, source, hours(t)[1], VH, HOUR)
    return out.select("venue", us("ts"), "price", "fetched")


@query("q15_table_sanity", """
WITH d AS (SELECT venue, ts, CASE WHEN seq % 20 = 0 THEN NULL ELSE price END AS price, volume FROM ticks),
g AS (SELECT epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY venue ORDER BY ts)) AS g FROM d),
m AS (SELECT quantile_cont(price, 0.5) AS med FROM d), a AS (SELECT quantile_cont(abs(price - med), 0.5) AS mad FROM d, m)
SELECT count(*) AS rows, round(avg(CASE WHEN price IS NULL THEN 1.0 ELSE 0 END), 6) AS null_price, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicate_rows,
  (SELECT round(quantile_cont(g, 0.5) / 1e6, 6) FROM g WHERE g IS NOT NULL) AS gap_median, (SELECT round(max(g) / 1e6, 6) FROM g) AS gap_max,
  (SELECT count(*) FROM d, m, a WHERE abs(price - med) / mad > 3) AS spikes_price FROM d""")
def sanity(t):
    d = t.ticks.select("venue", "ts", F.when(F.col("seq") % 20 != 0, F.col("price")).alias("price"), "volume")
    out = Q.table_sanity(d, ts="ts", numeric=["price"], threshold=3.0, keys=["venue"])
    return out.select("rows", F.round("null_price", 6).alias("null_price"), "duplicate_rows", F.round("gap_median", 6).alias("gap_median"),
                      F.round("gap_max", 6).alias("gap_max"), "spikes_price")


LET = """l AS (SELECT seq, ts, venue AS context, symbol AS payload, CASE WHEN seq % 2 = 0 THEN 'validation_error' ELSE 'unknown' END AS reason FROM ticks WHERE price > 60),
f AS (SELECT *, row_number() OVER (PARTITION BY payload ORDER BY ts, seq) AS failures FROM l)"""


def letters(t):
    return t.ticks.filter("price > 60").select("seq", "ts", F.col("venue").alias("context"), F.col("symbol").alias("payload"),
                                               F.when(F.col("seq") % 2 == 0, "validation_error").otherwise("unknown").alias("reason"))


@query("q16_dead_letter_log", "WITH " + LET + """ SELECT seq, sha256(payload) AS digest, failures, failures >= 10 AS toxic,
  CASE WHEN failures >= 10 THEN 'toxic_payload' ELSE reason END AS reason FROM f""")
def dead(t):
    return Q.dead_letter_log(letters(t), payload="payload", order=["ts", "seq"], threshold=10).select("seq", "digest", "failures", "toxic", "reason")


@query("q16_dead_letter_by_context", "WITH " + LET + """ SELECT context, count(*) AS letters, count(*) FILTER (WHERE failures >= 10) AS toxic FROM f GROUP BY context""")
def dead_stats(t):
    return Q.dead_letter_stats(Q.dead_letter_log(letters(t), payload="payload", order=["ts", "seq"], threshold=10), "context")


@query("q17_dead_letter_replay", "WITH " + LET + """ SELECT seq, CAST(2 AS BIGINT) AS attempts FROM f WHERE failures < 10 AND reason = 'unknown'
  AND payload NOT IN (SELECT symbol FROM ticks WHERE ts >= TIMESTAMP '2024-01-29' AND price > 100)""")
def replay(t):
    log = Q.dead_letter_log(letters(t), payload="payload", order=["ts", "seq"], threshold=10).withColumn("attempts", F.lit(1).cast("long"))
    done = t.ticks.filter("price > 100").select(F.sha2("symbol", 256).alias("digest"), F.col("ts").alias("replayed_at"))
    out = Q.replay_candidates(log, reasons=["unknown"], replayed=done, ttl=2 * DAY, as_of="2024-01-31", order=["ts", "seq"])
    return out.select("seq", "attempts")


@query("f1_retention", """
SELECT symbol, seq FROM (SELECT symbol, seq, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS k FROM ticks
  WHERE ts >= TIMESTAMP '2024-01-21') WHERE k <= 5""")
def retention(t):
    return PA.retain(t.ticks, ["symbol"], "ts", ttl=10 * DAY, as_of="2024-01-31", max_versions=5, seq=["seq"]).select("symbol", "seq")


@query("f2_integrity_report", """
SELECT count(*) AS offline_rows, count(*) AS online_rows, CAST(0 AS BIGINT) AS row_diff, true AS hash_match FROM ticks""")
def integrity_pair(t):
    path = scratch_dir(t.spark, "online")
    S.write_table(t.ticks, path)
    return PA.integrity_report(t.ticks, S.read_table(t.spark, path))


@query("f3_interval_validation", """
SELECT count(*) AS offline_rows, count(*) FILTER (WHERE seq % 97 <> 0) AS online_rows, count(*) FILTER (WHERE seq % 97 = 0) AS row_diff, false AS hash_match
FROM ticks WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'""")
def validation(t):
    part = t.ticks.filter((F.col("ts") >= F.lit("2024-01-10").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp")))
    return PA.integrity_report(part, part.filter(F.col("seq") % 97 != 0))


@query("f4_parity_sync", """
WITH a AS (SELECT symbol, time_bucket(INTERVAL '1 day', ts) AS ts, arg_max(price, seq) AS price, arg_max(venue, seq) AS venue FROM ticks GROUP BY 1, 2),
b AS (SELECT symbol, ts, price + CASE WHEN price > 200 THEN 1.5 ELSE 0 END AS price, venue FROM a WHERE ts < TIMESTAMP '2024-01-25'
  UNION ALL SELECT 'gone', TIMESTAMP '2024-01-02', 1, 'x')
SELECT count(*) FILTER (WHERE b.ts IS NULL) AS inserted, count(*) FILTER (WHERE a.ts IS NULL) AS removed, count(*) FILTER (WHERE abs(a.price - b.price) > 1) AS updated,
  round(max(abs(a.price - b.price)), 6) AS max_drift, (epoch_us(max(a.ts)) - epoch_us(max(b.ts))) / 1e6 AS clock_skew, '' AS columns_added, 'extra' AS columns_removed,
  'append_updates' AS blocked_by FROM a FULL JOIN b ON a.symbol = b.symbol AND a.ts = b.ts""")
def parity(t):
    a = PA.prepare(t.ticks.select("symbol", "ts", "seq", "price", "venue"), ["symbol"], "ts", ["seq"], DAY).drop("seq")
    old = a.filter(F.col("ts") < F.lit("2024-01-25").cast("timestamp")).withColumn(
        "price", F.col("price") + F.when(F.col("price") > 200, 1.5).otherwise(0.0))
    gone = a.limit(1).select(F.lit("gone").alias("symbol"), F.lit("2024-01-02").cast("timestamp").alias("ts"), F.lit(1.0).alias("price"), F.lit("x").alias("venue"))
    b = old.unionByName(gone).withColumn("extra", F.lit(0))
    out = PA.parity_report(a, b, ["symbol"], "ts", ["price", "venue"], tolerance=1.0, allow_schema_evolution=True)
    return out.withColumn("max_drift", F.round("max_drift", 6))


@query("f6_feature_lookup", """
SELECT seq, epoch_us(ts) AS ts, price FROM ticks WHERE ts < TIMESTAMP '2024-01-20' AND symbol = '8' ORDER BY ts DESC, seq DESC LIMIT 25""")
def lookup(t):
    return PA.lookup_page(t.ticks, "ts", cursor="2024-01-20", limit=25, where=F.col("symbol") == "8", tie=["seq"]).select("seq", us("ts"), "price")
