"""Execution analytics over fills, parent orders and quotes made from the ticks."""

from pyspark.sql import functions as F

from tickloom.functions.exprs import micros
from tickloom.operators import arbitrage as A
from tickloom.operators import execution as X
from tickloom.operators.axis import Axis
from tickloom.plans.aggregates import rnd
from tickloom.plans.registry import query, rounded_twice

DAY, WEEK = 86400.0, 604800.0
SEQ = ("ts", "line", "part", "broker")
COST = """f AS (SELECT order_id, sum(quantity) AS q, sum(quantity * price) AS n, sum(fees) AS fees, last(price ORDER BY ts, line, part, broker) AS lp FROM fills GROUP BY 1),
bm AS (SELECT order_id, sum(price * quantity) / sum(quantity) AS mv, arg_max(price, (ts, line, part, broker)) AS lb FROM fills WHERE status = 'O' GROUP BY 1),
j AS (SELECT p.*, q, n, fees, coalesce(mv, arrival_price) AS mv, coalesce(lb, lp) AS ref, CASE WHEN side = 'BUY' THEN 1.0 ELSE -1.0 END AS s FROM parents p JOIN f USING (order_id) LEFT JOIN bm USING (order_id)),
c AS (SELECT *, s * (n - arrival_price * q) + fees AS sf, s * (n / q - mv) AS vs, greatest(0, s * (ref - arrival_price) * (target_quantity - q)) AS oc FROM j)"""


def costs(t):
    b = t.fills.filter("status = 'O'").groupBy("order_id").agg(F.sum(F.col("price") * F.col("quantity")).alias("n"), F.sum("quantity").alias("volume"),
        F.max_by("price", F.struct(*SEQ)).alias("last"))
    # one weighted benchmark per order, then its last price with weight 0
    w = b.select("order_id", F.lit(0).alias("ts"), (F.col("n") / F.col("volume")).alias("price"), "volume")
    bench = w.unionByName(b.select("order_id", F.lit(1).alias("ts"), F.col("last").alias("price"), F.lit(0.0).alias("volume")))
    return X.order_costs(t.parents, t.fills, seq=SEQ, benchmarks=bench, market=t.fills.select("order_id", (F.col("quantity") * 4).alias("volume")))


@query("x1_implementation_shortfall", rounded_twice(f"WITH {COST} SELECT order_id, round(sf, 4) AS shortfall, round(sf / q, 4) AS per_share_shortfall FROM c"))
def x1(t):
    return rnd(costs(t).select("order_id", "shortfall", "per_share_shortfall"), "shortfall", "per_share_shortfall", digits=4, twice=True)


@query("x2_vwap_slippage", rounded_twice(f"WITH {COST} SELECT order_id, round(vs, 6) + 0.0 AS vwap_slippage FROM c"))
def x2(t):
    return rnd(costs(t).select("order_id", "vwap_slippage"), "vwap_slippage", twice=True).withColumn("vwap_slippage", F.col("vwap_slippage") + 0.0)


@query("x3_fill_rate", f"WITH {COST} SELECT order_id, round(least(1, q / target_quantity), 6) AS fill_rate FROM c")
def x3(t):
    return rnd(costs(t).select("order_id", "fill_rate"), "fill_rate")


@query("x4_cancel_replace_latency", """
WITH d AS (SELECT venue, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY symbol ORDER BY ts, seq))) / 1e6 AS d FROM ticks)
SELECT venue, count(d) AS count, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS max FROM d WHERE d IS NOT NULL GROUP BY venue""")
def x4(t):
    from tickloom.operators.aggregates import latency_report
    from tickloom.operators.axis import windowed
    d = windowed(t.ticks, t.by_symbol, lambda x, w: x.withColumn("d", (micros("ts") - F.lag(micros("ts")).over(w)) / 1e6), back=1)
    return rnd(latency_report(d.filter("d IS NOT NULL"), ["venue"], "d"), "mean", "p50", "p95", "max")


@query("x5_cost_breakdown", rounded_twice(f"WITH {COST} SELECT order_id, round(fees, 4) AS fees, round(vs * q, 4) + 0.0 AS slippage_cost, round(oc, 4) AS opportunity_cost, round(fees + vs * q + oc, 4) AS total_cost, round(least(1, q / (q * 4)), 6) AS participation FROM c"))
def x5(t):
    d = costs(t).select("order_id", "fees", "slippage_cost", "opportunity_cost", "total_cost", "participation")
    return rnd(rnd(d, "fees", "slippage_cost", "opportunity_cost", "total_cost", digits=4, twice=True), "participation", twice=True).withColumn("slippage_cost", F.col("slippage_cost") + 0.0)


@query("x6_order_latency", """
WITH o AS (SELECT o_orderpriority AS p, epoch_us(o_orderdate) / 1e6 AS a, epoch_us(min(l_shipdate)) / 1e6 AS b, epoch_us(max(l_shipdate)) / 1e6 AS c FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderdate),
l AS (SELECT p, 'submit_to_ack' AS leg, greatest(0, b - a) AS v FROM o UNION ALL SELECT p, 'ack_to_complete', greatest(0, c - b) FROM o UNION ALL SELECT p, 'submit_to_complete', greatest(0, c - a) FROM o)
SELECT p, leg, count(*) AS count, round(avg(v), 4) AS mean, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.95), 4) AS p95, max(v) AS max FROM l GROUP BY 1, 2""")
def x6(t):
    o = t.raw("orders").join(t.raw("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", F.col("o_orderpriority").alias("p"), F.col("o_orderdate").alias("a")).agg(
        F.min("l_shipdate").alias("b"), F.max("l_shipdate").alias("c"))
    return rnd(X.order_latency(o, ["p"], "a", "b", "c"), "mean", "p50", "p95", digits=4)


@query("x7_liquidity_report", rounded_twice("""
WITH b AS (SELECT part, epoch_us(ts) // 604800000000 AS w, avg(quantity * 2) AS a, sum(quantity) AS q FROM fills GROUP BY 1, 2)
SELECT part, round(avg(quantity * 2), 6) AS average_displayed, round(sum(quantity) / sum(quantity * 2), 6) AS coverage, round(any_value(pr), 6) AS book_pressure, round(quantile_cont(fees / quantity, 0.5), 6) AS median_spread
FROM fills JOIN (SELECT part, max(q / a) AS pr FROM b GROUP BY 1) USING (part) GROUP BY part"""))
def x7(t):
    s = t.fills.select("part", "ts", (F.col("quantity") * 2).alias("displayed_volume"), (F.col("fees") / F.col("quantity")).alias("spread_bps"))
    return rnd(X.liquidity_report(s, t.fills, ["part"], WEEK), "average_displayed", "coverage", "book_pressure", "median_spread", twice=True)


@query("x8_broker_comparison", """
SELECT broker, venue, sum(quantity) AS quantity, round(sum(quantity * price) / sum(quantity), 6) AS average_price, round(sum(fees), 3) AS fees, count(*) AS fill_count,
  round(sum(quantity * price) / sum(quantity) - 1500, 6) AS cost_per_share FROM fills GROUP BY 1, 2""")
def x8(t):
    d = X.broker_comparison(t.fills, ["broker", "venue"], F.lit("buy"), F.lit(1500.0))
    return rnd(rnd(d, "average_price", "cost_per_share"), "fees", digits=3)


@query("x9_periodic_costs", rounded_twice("""
WITH f AS (SELECT part, epoch_us(ts) // 604800000000 * 604800 AS bucket, sum(quantity) AS q, sum(quantity * price) / sum(quantity) AS v FROM fills WHERE status = 'F' GROUP BY 1, 2),
m AS (SELECT part, epoch_us(ts) // 604800000000 * 604800 AS bucket, sum(quantity) AS v FROM fills GROUP BY 1, 2),
b AS (SELECT part, epoch_us(ts) // 604800000000 * 604800 AS bucket, sum(price * quantity) / sum(quantity) AS p FROM fills WHERE status = 'O' GROUP BY 1, 2)
SELECT part, bucket, f.q AS executed, round(f.v, 6) AS vwap, round(least(1, f.q / m.v), 6) AS participation, round(f.v - coalesce(b.p, f.v), 6) + 0.0 AS slippage FROM f LEFT JOIN m USING (part, bucket) LEFT JOIN b USING (part, bucket)"""))
def x9(t):
    f = t.fills
    d = X.periodic_costs(f.filter("status = 'F'"), f.select("part", "ts", F.col("quantity").alias("volume")), f.filter("status = 'O'").select("part", "ts", "price", F.col("quantity").alias("volume")),
                         ["part"], WEEK, F.lit("buy"))
    return rnd(d, "vwap", "participation", "slippage", twice=True).withColumn("slippage", F.col("slippage") + 0.0)


@query("x10_recommendations", """
SELECT part, concat_ws(',', CASE WHEN max(quantity) / avg(quantity) > 1.2 THEN 'reduce_participation' END, CASE WHEN avg(fees / quantity) > 0.5 THEN 'tighten_limits' END) AS codes FROM fills GROUP BY part""")
def x10(t):
    a = t.fills.groupBy("part").agg((F.max("quantity") / F.avg("quantity")).alias("p"), F.avg(F.col("fees") / F.col("quantity")).alias("s"))
    return a.select("part", F.array_join(X.recommendations(F.lit(0.5), F.col("p"), F.col("s"), F.lit(0.1), F.lit(0.0)), ",").alias("codes"))


WALK = """lv AS (SELECT part, price, sum(quantity) AS q FROM fills WHERE status = 'O' GROUP BY 1, 2),
dp AS (SELECT *, sum(q) OVER (PARTITION BY part ORDER BY price) AS t FROM lv), o AS (SELECT part, 250.0 AS quantity, min(price) AS mid FROM fills GROUP BY 1),
j AS (SELECT o.part, o.quantity, o.mid, sum(greatest(0, least(o.quantity - (t - q), q))) AS filled, sum(greatest(0, least(o.quantity - (t - q), q)) * price) AS val, max(price) FILTER (WHERE t - q < o.quantity) AS lp, sum(q) AS depth
  FROM o LEFT JOIN dp USING (part) GROUP BY 1, 2, 3),
k AS (SELECT *, coalesce(filled, 0) AS fl, quantity - coalesce(filled, 0) AS short, (coalesce(val, 0) + (quantity - coalesce(filled, 0)) * coalesce(lp, mid) * 1.0015) / quantity AS ap FROM j)"""


def walked(t):
    lv = t.fills.filter("status = 'O'").select("part", F.lit("ask").alias("side"), "price", "quantity")
    o = t.fills.groupBy("part").agg(F.min("price").alias("mid")).select("part", F.lit("buy").alias("side"), F.lit(250.0).alias("quantity"), "mid")
    return X.walk_book(o, lv, book=["part"], order=["part"])


@query("x11_walk_book", rounded_twice(f"WITH {WALK} SELECT part, round(fl, 6) AS filled, round(short, 6) AS shortfall, round(ap, 6) AS average_price, round(coalesce(depth, 0) / quantity, 6) AS liquidity_score FROM k"))
def x11(t):
    return rnd(walked(t).select("part", "filled", "shortfall", "average_price", "liquidity_score"), "filled", "shortfall", "average_price", "liquidity_score", twice=True)


FC = WALK + ", e AS (SELECT *, greatest(0, ap - mid) AS base, mid * 0.05 * pow(0.1, 0.6) AS pc, mid * 0.04 * 0.02 AS vc, coalesce(depth, 0) / quantity AS ls FROM k), g AS (SELECT *, base + pc + vc AS es, (base + pc + vc) / mid * 1e4 AS bps FROM e)"


@query("x12_impact_forecast", f"WITH {FC} SELECT part, round(es, 6) AS expected_slippage, round(bps, 4) AS slippage_bps, round(es * quantity, 4) AS expected_cost, round(mid + es, 6) AS expected_price FROM g")
def x12(t):
    d = X.impact_forecast(walked(t), F.lit(0.1), F.lit(0.02))
    return rnd(rnd(d.select("part", "expected_slippage", "slippage_bps", "expected_cost", "expected_price"), "expected_slippage", "expected_price"), "slippage_bps", "expected_cost", digits=4)


@query("x13_parameter_adjustment", f"""WITH {FC}, h AS (SELECT *, bps > 20 OR ls < 1 AS tight, bps < 8 AND ls > 1.5 AS loose FROM g),
a AS (SELECT *, CASE WHEN tight THEN 0.15 WHEN loose THEN 0.23 ELSE 0.2 END AS p, CASE WHEN tight THEN 50.0 WHEN loose THEN 125.0 ELSE 100.0 END AS s, CASE WHEN tight THEN 6.0 WHEN loose THEN 4.0 ELSE 5.0 END AS o FROM h)
SELECT part, round(CASE WHEN vc > base THEN p * 0.9 ELSE p END, 6) AS new_participation, CAST(s AS DOUBLE) AS new_slice, CAST(CASE WHEN vc > base THEN o + 0.5 ELSE o END AS DOUBLE) AS new_offset FROM a""")
def x13(t):
    d = X.impact_forecast(walked(t), F.lit(0.1), F.lit(0.02)).withColumns({"participation_rate": F.lit(0.2), "slice_volume": F.lit(100.0), "limit_offset_bps": F.lit(5.0)})
    return rnd(X.adjust_parameters(d).select("part", "new_participation", "new_slice", "new_offset"), "new_participation")


for _kind, _sql in (("twap", "target_quantity / 4"), ("vwap", "target_quantity * [1, 2, 3, 4][i + 1] / 10"),
                    ("pov", "least(target_quantity, [10, 20, 30, 40][i + 1] * 0.5) + CASE WHEN i = 3 THEN greatest(0, target_quantity - least(target_quantity, 5) - least(target_quantity, 10) - least(target_quantity, 15) - least(target_quantity, 20)) ELSE 0 END")):
    @query(f"x14_schedule_{_kind}", f"SELECT order_id, i AS slice, round({_sql}, 6) AS child_quantity, epoch_us(ts) + CAST(i AS BIGINT) * 900000000 AS scheduled FROM parents, (VALUES (0), (1), (2), (3)) v(i)")
    def x14(t, kind=_kind):
        profile = {"twap": 4, "vwap": [1, 2, 3, 4], "pov": [10, 20, 30, 40]}[kind]
        d = X.schedule(t.parents, kind, duration=3600.0, profile=profile, participation=0.5, quantity="target_quantity")
        return d.select("order_id", "slice", F.round("child_quantity", 6).alias("child_quantity"), micros("scheduled").alias("scheduled"))


ORD = Axis(("order_id",), "ts", ("n",))


def events(t):
    kinds = F.array(*[F.lit(x) for x in ("submit", "ack", "fill_partial", "fill_final", "cancel")])
    return t.ticks.select(F.col("symbol").alias("order_id"), "ts", F.col("seq").alias("n"), kinds[(F.col("seq") % 5).cast("int")].alias("event"),
                          F.concat(F.lit("c"), F.floor(F.col("seq") / 2)).alias("correlation_id"))


STATES = f"""tr(s, e, z) AS (VALUES {", ".join(f"('{a}', '{e}', '{z}')" for (a, e), z in X.TRANSITIONS.items())}),
ev AS (SELECT symbol AS order_id, ts, seq AS n, ['submit', 'ack', 'fill_partial', 'fill_final', 'cancel'][seq % 5 + 1] AS event FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol, seq // 2 ORDER BY ts, seq) = 1),
en AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ts, n) AS k FROM ev),
st AS (SELECT order_id, CAST(0 AS BIGINT) AS k, 'pending' AS s FROM en GROUP BY 1 UNION ALL SELECT en.order_id, en.k, coalesce(tr.z, st.s) FROM st JOIN en ON en.order_id = st.order_id AND en.k = st.k + 1 LEFT JOIN tr ON tr.s = st.s AND tr.e = en.event)"""


@query("x15_order_states", f"""WITH RECURSIVE {STATES}
SELECT en.order_id, en.n, en.event, a.s AS from_status, b.s AS to_status, tr.z IS NOT NULL AS legal FROM en JOIN st a ON a.order_id = en.order_id AND a.k = en.k - 1 JOIN st b ON b.order_id = en.order_id AND b.k = en.k
LEFT JOIN tr ON tr.s = a.s AND tr.e = en.event""")
def x15(t):
    return X.order_states(events(t), ORD).select("order_id", "n", "event", "from_status", "to_status", "legal")


@query("x24_latest_orders", f"""WITH RECURSIVE {STATES}
SELECT en.order_id, arg_max(b.s, en.k) AS status, count(*) AS transitions FROM en JOIN st a ON a.order_id = en.order_id AND a.k = en.k - 1 JOIN st b ON b.order_id = en.order_id AND b.k = en.k
JOIN tr ON tr.s = a.s AND tr.e = en.event GROUP BY en.order_id""")
def x24(t):
    return X.latest_states(X.order_states(events(t), ORD), ORD)


def signed_fills(t):
    return t.fills.withColumn("signed_quantity", F.when(F.col("status") == "F", F.col("quantity")).otherwise(-F.col("quantity")))


@query("x16_positions", """
SELECT part, order_id, line, broker, sum(CASE WHEN status = 'F' THEN quantity ELSE -quantity END) OVER (PARTITION BY part ORDER BY ts, order_id, line, part, broker) AS position FROM fills""")
def x16(t):
    return X.positions(signed_fills(t), t.by_part).select("part", "order_id", "line", "broker", "position")


@query("x16_position_profit")
def x16b(t):
    return rnd(X.positions(signed_fills(t), t.by_part).select("part", "order_id", "line", "broker", "entry_price", "realized", "unrealized"), "entry_price", "realized", "unrealized", digits=4)


@query("x17_cash_ledger", """
SELECT order_id, line, 'trade' AS kind, round(CASE WHEN status = 'F' THEN -1 ELSE 1 END * quantity * price, 4) AS amount FROM fills UNION ALL SELECT order_id, line, 'fee', round(-fees, 4) FROM fills WHERE fees <> 0""")
def x17(t):
    d = t.fills.select("order_id", "line", F.when(F.col("status") == "F", "buy").otherwise("sell").alias("side"), (F.col("quantity") * F.col("price")).alias("gross"), F.col("fees").alias("fee"))
    return rnd(X.cash_rows(d), "amount", digits=4)


RULE = A.Rule(max_age=DAY, max_skew=DAY, fee=0.001, fees={"view": 0.002, "click": 0.0}, min_edge=0.01, min_profit=1.0)


def quotes_and_balances(ticks):
    """Quotes around the price, and at every 7th tick a balance of the venue before them."""
    p = F.col("price")
    quotes = ticks.select("symbol", "ts", (F.col("seq") * 2 + 1).alias("seq"), "venue", (p - 0.5).alias("bid"), (p + 0.5).alias("ask"), F.col("volume").alias("bid_size"), (F.col("volume") + 1).alias("ask_size"))
    held = ticks.where("seq % 7 = 0").select("symbol", "ts", (F.col("seq") * 2).alias("seq"), "venue", (F.col("volume") - 10).alias("base_available"), (F.col("price") * 20).alias("quote_available"))
    return quotes, held


TRADES = rounded_twice("""
WITH q AS (SELECT symbol, venue, ts, seq * 2 + 1 AS seq, (ts, seq * 2 + 1) AS at, price - 0.5 AS bid, price + 0.5 AS ask, volume AS bs, volume + 1 AS az FROM ticks),
h AS (SELECT symbol, venue, (ts, seq * 2) AS at, volume - 10 AS base, price * 20 AS cash FROM ticks WHERE seq % 7 = 0), v AS (SELECT DISTINCT symbol, venue FROM ticks),
s AS (SELECT q.symbol, q.ts, q.seq, q.at, v.venue FROM q JOIN v USING (symbol)), l AS (SELECT s.*, q.ts AS qt, q.bid, q.ask, q.bs, q.az FROM s ASOF JOIN q ON s.symbol = q.symbol AND s.venue = q.venue AND s.at >= q.at),
b AS (SELECT l.*, h.base, h.cash FROM l ASOF LEFT JOIN h ON l.symbol = h.symbol AND l.venue = h.venue AND l.at >= h.at WHERE l.ts - l.qt <= INTERVAL 1 DAY),
g AS (SELECT symbol, seq, any_value(ts) AS ts, count(*) AS n, first(struct_pack(venue, qt, p := bid, z := bs, have := base) ORDER BY bid DESC, venue) AS s, first(struct_pack(venue, qt, p := ask, z := az, have := cash) ORDER BY ask, venue) AS b FROM b GROUP BY 1, 2),
z AS (SELECT *, least(b.z, s.z, coalesce(b.have / b.p, 1e300), coalesce(s.have, 1e300)) AS size FROM g WHERE n > 1 AND s.venue <> b.venue AND s.p > b.p),
t AS (SELECT symbol, seq, b.venue AS buy_venue, s.venue AS sell_venue, b.p AS buy_price, s.p AS sell_price, size, size * b.p AS notional,
  (s.p - b.p) * size - size * b.p * CASE b.venue WHEN 'view' THEN 0.002 WHEN 'click' THEN 0 ELSE 0.001 END - size * s.p * CASE s.venue WHEN 'view' THEN 0.002 WHEN 'click' THEN 0 ELSE 0.001 END AS profit FROM z WHERE size > 0)
SELECT symbol, seq, buy_venue, sell_venue, round(buy_price, 6) AS buy_price, round(sell_price, 6) AS sell_price, round(size, 6) AS size, round(notional, 4) AS notional, round(profit, 4) AS profit FROM t WHERE profit > 0 AND profit >= 1 AND profit / notional >= 0.01""")


def shown(d):
    d = d.select("symbol", "seq", "buy_venue", "sell_venue", "buy_price", "sell_price", "size", "notional", "profit")
    return rnd(rnd(d, "buy_price", "sell_price", "size", twice=True), "notional", "profit", digits=4, twice=True)


@query("x18_arbitrage", TRADES)
def x18(t):
    quotes, held = quotes_and_balances(t.ticks)
    return shown(A.arbitrage(quotes, t.by_symbol, RULE, balances=held))


@query("x19_venue_latency", """
SELECT venue, count(*) AS n, round(quantile_cont(volume, 0.5), 6) AS p50, round(quantile_cont(volume, 0.95), 6) AS p95, round(quantile_cont(volume, 0.99), 6) AS p99
FROM (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY ts DESC, seq DESC) AS k FROM ticks) WHERE k <= 500 GROUP BY venue""")
def x19(t):
    return rnd(X.venue_latency(t.ticks, ["venue"], ["ts", "seq"], "volume", 500), "p50", "p95", "p99")


@query("x20_inventory", """
WITH i AS (SELECT symbol, venue, sum(volume) AS base, sum(price) AS quote, count(*) AS weight FROM ticks GROUP BY 1, 2),
d AS (SELECT *, least(sum(base) OVER s * weight / sum(weight) OVER s, sum(base) OVER s * 0.3) AS desired FROM i WINDOW s AS (PARTITION BY symbol))
SELECT symbol, venue, round(desired, 6) AS desired, round(CASE WHEN base > desired AND quote >= 200 THEN least(base - desired, greatest(base - 100, 0)) ELSE 0 END, 6) AS surplus,
  round(CASE WHEN base <= desired THEN greatest(greatest(desired, 100) - base, 0) ELSE 0 END, 6) AS deficit FROM d""")
def x20(t):
    i = t.ticks.groupBy("symbol", "venue").agg(F.sum("volume").alias("base"), F.sum("price").alias("quote"), F.count(F.lit(1)).cast("double").alias("weight")).withColumns(
        {"min_base": F.lit(100.0), "min_quote": F.lit(200.0), "max_weight": F.lit(0.3)})
    return rnd(X.inventory(i, ["symbol"]).select("symbol", "venue", "desired", "surplus", "deficit"), "desired", "surplus", "deficit")


@query("x21_book_rules", """
SELECT seq, concat_ws(',', CASE WHEN seq % 7 = 0 THEN 'negative_quantity' END, CASE WHEN seq % 11 = 0 THEN 'arrival_before_event' END, CASE WHEN seq % 5 = 0 THEN 'zero_quantity' END, CASE WHEN seq % 3 = 0 THEN 'bids_not_descending' END) AS broken FROM ticks""")
def x21(t):
    s, p = F.col("seq"), F.col("price")
    lv = lambda price, q: F.struct(price.alias("price"), q.alias("quantity"))
    q = F.when(s % 7 == 0, -1.0).otherwise(1.0)
    d = t.ticks.select("seq", F.array(lv(p, q), lv(p + F.when(s % 3 == 0, 1.0).otherwise(-1.0), F.lit(2.0))).alias("bids"),
                       F.array(lv(p + 2, F.when(s % 5 == 0, 0.0).otherwise(1.0)), lv(p + 3, F.lit(1.0))).alias("asks"), F.col("ts").alias("ts_event"),
                       F.when(s % 11 == 0, F.col("ts") - F.expr("interval 1 second")).otherwise(F.col("ts")).alias("ts_arrival"))
    return d.select("seq", F.array_join(X.book_rules(), ",").alias("broken"))


@query("x22_book_state", """
WITH u AS (SELECT symbol, seq, CASE WHEN seq % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, floor(price / 10) * 10 AS price, CASE WHEN volume < 20 THEN 0 ELSE volume END AS q, seq % 40 = 0 AS snap FROM ticks),
s AS (SELECT *, max(CASE WHEN snap THEN seq END) OVER (PARTITION BY symbol) AS ls FROM u), l AS (SELECT symbol, side, price, arg_max(q, seq) AS q FROM s WHERE ls IS NULL OR seq >= ls GROUP BY 1, 2, 3)
SELECT symbol, side, price, q AS quantity, k AS level FROM (SELECT *, row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS k FROM l WHERE q > 0) WHERE k <= 3""")
def x22(t):
    s = F.col("seq")
    u = t.ticks.select("symbol", "seq", F.when(s % 2 == 0, "bid").otherwise("ask").alias("side"), (F.floor(F.col("price") / 10) * 10).cast("double").alias("price"),
                       F.when(F.col("volume") < 20, 0.0).otherwise(F.col("volume")).alias("quantity"), F.when(s % 40 == 0, "snapshot").otherwise("diff").alias("kind"))
    return X.book_state(u, ["symbol"], depth=3).withColumn("level", F.col("level").cast("long"))


@query("x23_quote_stats", rounded_twice("""
SELECT seq, price AS mid, round(volume, 6) AS spread, round(avg(volume / 50) OVER (PARTITION BY venue ORDER BY ts, seq ROWS 255 PRECEDING), 6) AS mean_latency FROM ticks"""))
def x23(t):
    d = t.ticks.withColumns({"bid": F.col("price") - F.col("volume") / 2, "ask": F.col("price") + F.col("volume") / 2, "received": F.timestamp_micros(micros("ts") + (F.col("volume") * 20000).cast("long"))})
    return rnd(X.quote_stats(d, t.by_venue).select("seq", F.round("mid", 6).alias("mid"), "spread", "mean_latency"), "spread", "mean_latency", twice=True)
