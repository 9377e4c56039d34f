"""Projection, filters, casts, scaling, order rules."""

from pyspark.sql import functions as F

from tickloom.functions.exprs import micros, natural_log
from tickloom.functions.symbols import symbol_code, venue_code
from tickloom.operators import cleaning as P
from tickloom.operators.axis import Axis
from tickloom.plans.registry import query


def us(c, name=None):
    return micros(c).alias(name or c)


@query("p1_predicates", "SELECT seq, symbol, price FROM ticks WHERE price > 50 AND volume >= 10 AND venue <> 'error'")
def predicates(t):
    rules = [F.col("price") > 50, lambda: F.col("volume") >= 10, F.col("venue") != "error"]
    return P.where_all(t.ticks, rules).select("seq", "symbol", "price")


@query("p2_named_expressions", """
SELECT seq, round(price * volume, 6) AS notional, round(ln(price), 6) AS log_price FROM ticks""")
def expressions(t):
    named = {"notional": F.round(F.col("price") * F.col("volume"), 6), "log_price": lambda: F.round(natural_log(F.col("price")), 6)}
    return P.with_expressions(t.ticks, named).select("seq", *named)


@query("p3_enforce_schema", """
SELECT seq, CAST(CAST(TRUNC(price) AS BIGINT) AS BIGINT) AS price, TRY_CAST(venue AS DOUBLE) AS venue, symbol FROM ticks""")
def schema(t):
    whole = t.ticks.withColumn("price", F.floor("price"))
    strict = P.enforce_schema(whole, {"price": "bigint", "seq": "bigint"})
    return P.enforce_schema(strict, {"venue": "double"}, strict=False).select("seq", "price", "venue", "symbol")


@query("p4_time_slice", """
SELECT seq, epoch_us(ts) AS ts, price FROM ticks WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12 12:00:00'""")
def slice_(t):
    return P.time_slice(t.ticks, "ts", "2024-01-10", "2024-01-12 12:00:00").select("seq", us("ts"), "price")


@query("p5_feature_pick", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_shipdate IS NULL AS x FROM lineitem")
def pick(t):
    li = t.raw("lineitem").withColumn("x", F.col("l_shipdate").isNull())
    return P.pick_features(li, ["l_orderkey", "x"], prefixes=["l_ext", "l_disc"], names=["l_linenumber"])


@query("p6_normalize_frame", """
WITH d AS (SELECT DISTINCT symbol, ts, seq, CASE WHEN seq % 4 <> 0 THEN price END AS price FROM ticks),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS pos FROM d),
p AS (SELECT *, last_value(CASE WHEN price IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS t0, last_value(price IGNORE NULLS) OVER a AS p0,
  first_value(CASE WHEN price IS NOT NULL THEN pos END IGNORE NULLS) OVER z AS t1, first_value(price IGNORE NULLS) OVER z AS p1
  FROM n WINDOW a AS (PARTITION BY symbol ORDER BY pos),
  z AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT symbol, seq, epoch_us(ts) AS ts, round(CASE WHEN price IS NOT NULL THEN price WHEN p1 IS NULL THEN p0 WHEN p0 IS NULL THEN p1
  ELSE p0 + (p1 - p0) * (pos - t0) / (t1 - t0) END, 6) AS price FROM p""")
def frame(t):
    holes = t.ticks.select("symbol", (micros("ts") / 1e6).alias("ts"), "seq",
                           F.when(F.col("seq") % 4 != 0, F.col("price")).alias("price"))
    doubled = holes.unionByName(holes)
    out = P.normalize_frame(doubled, t.by_symbol, ["price"])
    return out.select("symbol", "seq", us("ts"), F.round("price", 6).alias("price"))


@query("p7_venue_normalize", """
WITH v AS (SELECT seq, CASE seq % 5 WHEN 0 THEN ' binance-spot ' WHEN 1 THEN 'Gdax' WHEN 2 THEN 'binance perp'
  WHEN 3 THEN 'polygon.io' ELSE venue END AS raw FROM ticks)
SELECT seq, CASE upper(trim(raw)) WHEN 'BINANCE-SPOT' THEN 'BINANCE' WHEN 'GDAX' THEN 'COINBASE' WHEN 'BINANCE PERP'
  THEN 'BINANCE_FUTURES' WHEN 'POLYGON.IO' THEN 'POLYGON' ELSE upper(trim(raw)) END AS venue FROM v""")
def venue(t):
    m = F.col("seq") % 5
    raw = F.when(m == 0, " binance-spot ").when(m == 1, "Gdax").when(m == 2, "binance perp").when(
        m == 3, "polygon.io").otherwise(F.col("venue"))
    return t.ticks.select("seq", venue_code(raw).alias("venue"))


@query("p8_symbol_normalize", """
WITH v AS (SELECT seq, seq % 6 AS m, upper(venue) AS u FROM ticks)
SELECT seq, CASE m WHEN 0 THEN u || '/USDT' WHEN 1 THEN 'BTC/USDT' WHEN 2 THEN u || '/EUR'
  WHEN 3 THEN u || '-USD-PERP' WHEN 4 THEN u ELSE u || '/USDC' END AS symbol FROM v""")
def symbol(t):
    m, v = F.col("seq") % 6, F.col("venue")
    raw = F.when(m == 0, F.concat(v, F.lit("_usdt"))).when(m == 1, F.lit(" btcusdt ")).when(m == 2, F.concat(v, F.lit("EUR"))).when(
        m == 3, F.concat(v, F.lit("-usd-perp"))).when(m == 4, v).otherwise(F.concat(v, F.lit(":usdc:spot")))
    return t.ticks.select("seq", symbol_code(raw).alias("symbol"))


SPECS = """(VALUES ('A', 0.5, 2.0, 0.05, 100.0), ('N', 1.0, 5.0, 0.01, 5000.0), ('R', 0.25, 0.0, 0.10, 0.0))
  s(venue, step_size, min_qty, tick_size, min_notional)"""


def specs(t):
    return t.spark.createDataFrame([("A", 0.5, 2.0, 0.05, 100.0), ("N", 1.0, 5.0, 0.01, 5000.0), ("R", 0.25, 0.0, 0.10, 0.0)],
                                   "venue string, step_size double, min_qty double, tick_size double, min_notional double")


def orders(t):
    return t.fills.select("order_id", "line", "part", "broker", "venue", (F.col("quantity") / 3).alias("quantity"),
                          F.round("price", 4).alias("price"))


ORDERS = "SELECT order_id, line, part, broker, venue, quantity / 3 AS quantity, round(price, 4) AS price FROM fills"
NORMED = f"""
n AS (SELECT o.*, s.*, floor(quantity / step_size + 0.5 + 1e-9) * step_size AS nq,
  floor(price / tick_size + 0.5 + 1e-9) * tick_size AS np FROM ({ORDERS}) o JOIN {SPECS} USING (venue))"""


@query("p9_round_to_step", f"WITH {NORMED} SELECT order_id, line, part, broker, round(nq, 6) AS quantity, round(np, 4) AS price FROM n")
def rounding(t):
    d = orders(t).join(F.broadcast(specs(t)), "venue")
    return d.select("order_id", "line", "part", "broker",
                    F.round(P.round_to_step(F.col("quantity"), F.col("step_size")), 6).alias("quantity"),
                    F.round(P.round_to_step(F.col("price"), F.col("tick_size")), 4).alias("price"))


@query("p10_constraint_validation", f"""
WITH o AS (SELECT *, round(quantity * 4) / 4 AS q, round(price * 20) / 20 AS p FROM ({ORDERS}))
SELECT order_id, line, part, broker, concat_ws(',',
  CASE WHEN CAST(q AS DECIMAL(28,10)) % CAST(step_size AS DECIMAL(28,10)) <> 0 THEN 'quantity_step' END,
  CASE WHEN q < min_qty THEN 'min_quantity' END,
  CASE WHEN CAST(p AS DECIMAL(28,10)) % CAST(tick_size AS DECIMAL(28,10)) <> 0 THEN 'price_tick' END,
  CASE WHEN min_notional > 0 AND q * p < min_notional THEN 'min_notional' END) AS violations
FROM o JOIN {SPECS} USING (venue)""")
def constraints(t):
    d = orders(t).withColumn("quantity", F.round(F.col("quantity") * 4) / 4).withColumn(
        "price", F.round(F.col("price") * 20) / 20).join(F.broadcast(specs(t)), "venue")
    return d.select("order_id", "line", "part", "broker",
                    F.array_join(P.order_violations(F.col("quantity"), F.col("price")), ",").alias("violations"))


@query("p11_scale_zscore", """
SELECT seq, round(coalesce((price - avg(price) OVER w) / nullif(stddev_pop(price) OVER w, 0), 0), 6) AS scaled
FROM ticks WINDOW w AS (PARTITION BY symbol)""")
def zscore(t):
    return P.scale(t.ticks, ["symbol"], "price").select("seq", F.round("scaled", 6).alias("scaled"))


@query("p11_scale_minmax", """
SELECT seq, round(coalesce((price - min(price) OVER w) / nullif(max(price) OVER w - min(price) OVER w, 0), 0), 6) AS scaled
FROM ticks WINDOW w AS (PARTITION BY venue)""")
def minmax(t):
    return P.scale(t.ticks, ["venue"], "price", "minmax").select("seq", F.round("scaled", 6).alias("scaled"))


@query("p12_leakage_gate", """
WITH f AS (SELECT symbol, seq, ts, CASE WHEN volume > 0 THEN price / volume END AS x, price AS y FROM ticks),
l AS (SELECT symbol, seq, lag(x, 2) OVER w AS x, lag(y, 2) OVER w AS y FROM f WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq))
SELECT symbol, seq, round(x, 9) AS x, y FROM l WHERE x IS NOT NULL AND y IS NOT NULL""")
def gate(t):
    x = F.when(F.col("volume") > 0, F.col("price") / F.nullif(F.col("volume"), F.lit(0.0))).otherwise(F.lit(float("inf")))
    feats = t.ticks.withColumn("x", x).withColumn("y", F.col("price"))
    out = P.leakage_gate(feats, t.by_symbol, ["x", "y"], lag=2)
    return out.select("symbol", "seq", F.round("x", 9).alias("x"), "y")


@query("p13_first_values", """
SELECT symbol, first(price ORDER BY ts, seq) FILTER (WHERE price > 100) AS price, first(venue ORDER BY ts, seq) AS venue
FROM ticks GROUP BY symbol""")
def firsts(t):
    d = t.ticks.withColumn("price", F.when(F.col("price") > 100, F.col("price")))
    return P.first_values(d, ["symbol"], ["price", "venue"], ["ts", "seq"])


@query("p14_nested_key", """
SELECT seq, symbol || '|' || coalesce(CASE WHEN price > 20 THEN venue END, 'None') || '|' || seq AS key FROM ticks""")
def nested(t):
    d = t.ticks.select("seq", F.struct("symbol", F.struct(F.when(F.col("price") > 20, F.col("venue")).alias("v"), "seq").alias("m")).alias("a"))
    return d.select("seq", P.path_key(["a.symbol", "a.m.v", "a.m.seq"]).alias("key"))


LIC = "CASE doc_id % 4 WHEN 0 THEN 'CC-BY' WHEN 1 THEN '' WHEN 2 THEN 'GPL' ELSE 'MIT' END"


@query("p15_licence_compliance", f"""
WITH m AS (SELECT doc_id, {LIC} AS license, CASE doc_id % 3 WHEN 0 THEN 'research' WHEN 1 THEN 'resale' ELSE '' END AS usage,
  lang AS region, ts + INTERVAL 2 DAY AS expires_at FROM news)
SELECT doc_id, concat_ws(',', CASE WHEN license = '' THEN 'error:license_missing' END,
  CASE WHEN license = 'GPL' THEN 'error:license_restricted' END,
  CASE WHEN license NOT IN ('', 'GPL', 'MIT') THEN 'warning:license_unlisted' END,
  CASE WHEN usage = 'resale' THEN 'error:usage_not_permitted' END, CASE WHEN usage = '' THEN 'warning:usage_unspecified' END,
  CASE WHEN region = 'de' THEN 'error:region_restricted' END,
  CASE WHEN expires_at < TIMESTAMP '2024-01-03 06:00:00' THEN 'error:license_expired' END) AS issues,
  NOT (license IN ('', 'GPL') OR usage = 'resale' OR region = 'de' OR expires_at < TIMESTAMP '2024-01-03 06:00:00') AS compliant
FROM m""")
def licence(t):
    k = F.col("doc_id")
    meta = t.news.select(
        "doc_id", F.when(k % 4 == 0, "CC-BY").when(k % 4 == 1, "").when(k % 4 == 2, "GPL").otherwise("MIT").alias("license"),
        F.when(k % 3 == 0, "research").when(k % 3 == 1, "resale").otherwise("").alias("usage"), F.col("lang").alias("region"),
        (F.col("ts") + F.expr("interval 2 days")).alias("expires_at"))
    out = P.licence_check(meta, as_of=F.lit("2024-01-03 06:00:00").cast("timestamp"), allowed=["MIT"], restricted=["GPL"], regions=["DE"])
    return out.select("doc_id", F.array_join("issues", ",").alias("issues"), "compliant")


@query("p16_order_compliance", f"""WITH {NORMED}
SELECT order_id, line, part, broker, round(nq, 6) AS normalized_quantity, round(np, 4) AS normalized_price,
  CASE WHEN nq < min_qty THEN 'min_quantity' WHEN min_notional > 0 AND nq * np < min_notional THEN 'min_notional' END AS violation,
  (nq < min_qty OR (min_notional > 0 AND nq * np < min_notional)) AS blocked FROM n""")
def compliance(t):
    out = P.check_orders(orders(t), specs(t), "venue")
    return out.select("order_id", "line", "part", "broker", F.round("normalized_quantity", 6).alias("normalized_quantity"),
                      F.round("normalized_price", 4).alias("normalized_price"), "violation", "blocked")
