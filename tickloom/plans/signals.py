"""Signals, scoring, profit-and-loss, performance statistics, folds."""

from pyspark.sql import functions as F

from tickloom.operators import folds as FO
from tickloom.operators import performance as PF
from tickloom.operators import signals as SG
from tickloom.operators.axis import Axis, running, windowed
from tickloom.operators.windows import pct_change
from tickloom.plans.aggregates import rnd
from tickloom.plans.indicators import hilbert
from tickloom.plans.registry import query, rounded_twice
from tickloom.plans.windows import MACD, ema, features

DAY = 86400.0
W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)"


@query("g1_moving_average_signal", """
WITH m AS (SELECT *, CASE WHEN count(*) OVER s = 3 THEN avg(price) OVER s END AS f FROM ticks WINDOW s AS (PARTITION BY symbol ORDER BY ts, seq ROWS 2 PRECEDING)),
h AS (SELECT *, coalesce(f, first_value(f IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS a FROM m)
SELECT seq, CASE WHEN price >= a THEN 1.0 ELSE -1.0 END::DOUBLE AS signal, CASE WHEN price > 50 THEN 1.0 ELSE -1.0 END::DOUBLE AS above FROM h""")
def g1(t):
    return SG.moving_average_signal(t.ticks, t.by_symbol).select("seq", "signal", SG.threshold_signal(F.col("price"), 50.0).alias("above"))


@query("g2_kuramoto_strategy", f"""
WITH x AS MATERIALIZED (SELECT venue AS k, seq, row_number() OVER (PARTITION BY venue ORDER BY ts, seq) - 1 AS i, count(*) OVER (PARTITION BY venue) AS n, price AS x FROM ticks), h AS ({hilbert("x")}),
s AS (SELECT k, i, CASE WHEN i >= 9 THEN least(sqrt((sum(cos(atan2(im, re))) OVER w) ** 2 + (sum(sin(atan2(im, re))) OVER w) ** 2) / count(*) OVER w, 1) ELSE 0 END AS r FROM h WINDOW w AS (PARTITION BY k ORDER BY i ROWS 49 PRECEDING))
SELECT k AS venue, seq, round(r, 6) AS kuramoto, CASE WHEN i >= 9 AND r >= 0.7 THEN 'Buy' WHEN i >= 9 AND r <= 0.3 THEN 'Sell' ELSE 'Hold' END AS signal,
  round(CASE WHEN i >= 9 AND r >= 0.7 THEN least((r - 0.7) / 0.3, 1) WHEN i >= 9 AND r <= 0.3 THEN (0.3 - r) / 0.3 ELSE 0 END, 6) AS confidence FROM s JOIN x USING (k, i)""")
def g2(t):
    return rnd(SG.kuramoto_strategy(t.ticks, t.by_venue, "price", 50).select("venue", "seq", "kuramoto", "signal", "confidence"), "kuramoto", "confidence")


@query("g3_hurst_vpin_strategy")
def g3(t):
    d = t.ticks.withColumn("b", F.when(F.col("seq") % 2 == 0, F.col("volume")).otherwise(0.0)).withColumn("s", F.when(F.col("seq") % 2 == 1, F.col("volume")).otherwise(0.0))
    return rnd(SG.hurst_vpin_strategy(d, t.by_venue, "price", "volume", "b", "s", hurst_window=30).select("venue", "seq", "hurst", "vpin", "signal", "confidence"),
               "hurst", "vpin", "confidence")


@query("g4_heuristic_signal", f"""
WITH {MACD}, x AS (SELECT *, price / lag(price) OVER w - 1 AS ret FROM ticks {W}),
vo AS (SELECT seq, CASE WHEN count(ret) OVER h = 20 THEN stddev_samp(ret) OVER h ELSE 0 END AS vol FROM x WINDOW h AS (PARTITION BY symbol ORDER BY ts, seq ROWS 19 PRECEDING)),
st AS (SELECT *, price - lag(price) OVER w AS s FROM ticks {W}), gs AS (SELECT * FROM st WHERE s IS NOT NULL),
ud AS (SELECT seq, count(*) OVER w AS k, {ema('greatest(s, 0)', '(1.0 / 14)')} AS u, {ema('greatest(-s, 0)', '(1.0 / 14)')} AS v FROM gs {W}),
rs AS (SELECT seq, 100 - 100 / (1 + u / (v + 1e-12)) AS rsi FROM ud WHERE k >= 14),
l AS (SELECT x.symbol, macd, sig, ret, (volume - price) / (volume + price) AS q, row_number() OVER (PARTITION BY x.symbol ORDER BY x.ts DESC, x.seq DESC) AS k, rsi, vol FROM x JOIN s USING (seq) JOIN vo USING (seq) LEFT JOIN rs USING (seq)),
c AS (SELECT symbol, tanh(macd) * 0.28 + tanh(macd - sig) * 0.24 + tanh((macd - sig) * 2) * 0.18 + tanh(ret * 120) * 0.1 + tanh(q) * 0.06 + (coalesce(rsi, 50) - 50) / 50 * 0.12 - abs(vol) * 0.04 AS score FROM l WHERE k = 1)
SELECT symbol, round(score, 6) AS score, CASE WHEN score > 0.12 THEN 'BUY' WHEN score < -0.12 THEN 'SELL' ELSE 'HOLD' END AS action, round(least(abs(score) / 0.85, 1), 6) AS confidence FROM c""")
def g4(t):
    return rnd(SG.heuristic_signal(features(t, (20,)), ["symbol"], ["ts", "seq"]).select("symbol", "score", "action", "confidence"), "score", "confidence")


@query("g5_signals_from_scores", """
WITH s AS (SELECT seq, CASE WHEN seq % 10 = 0 THEN NULL ELSE (price - 50) / 100 END AS score FROM ticks)
SELECT seq, round(score, 6) AS score, CASE WHEN score > 0 THEN 'BUY' WHEN score < 0 THEN 'SELL' ELSE 'HOLD' END AS action, round(least(abs(score), 1), 6) AS confidence FROM s WHERE score IS NOT NULL""")
def g5(t):
    d = t.ticks.withColumn("score", F.when(F.col("seq") % 10 == 0, F.lit(float("nan"))).otherwise((F.col("price") - 50) / 100))
    return rnd(SG.signals_from_scores(d, "score").select("seq", "score", "action", "confidence"), "score", "confidence")


def reversion_sql(lookback, thr, budget, x=""):
    return f"""r{x} AS (SELECT symbol, ts, seq, r FROM (SELECT symbol, ts, seq, price / lag(price) OVER w - 1 AS r FROM ticks {W}) WHERE r IS NOT NULL),
z{x} AS (SELECT *, CASE WHEN count(*) OVER s >= {lookback} THEN avg(r) OVER s ELSE 0 END AS m, nullif(stddev_pop(r) OVER s, 0) AS v FROM r{x} WINDOW s AS (PARTITION BY symbol ORDER BY ts, seq ROWS {lookback - 1} PRECEDING)),
q{x} AS (SELECT *, m / coalesce(last_value(v IGNORE NULLS) OVER w, first_value(v IGNORE NULLS) OVER f, 1e-6) AS z FROM z{x} {W},
  f AS (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
p{x} AS (SELECT *, coalesce(lag(CASE WHEN z > {thr} THEN -1.0 WHEN z < -{thr} THEN 1.0 ELSE 0.0 END) OVER w, 0) * {budget} AS pos FROM q{x} {W}),
e{x} AS (SELECT *, pos * r AS pnl, sum(pos * r) OVER w AS equity, pos <> lag(pos) OVER w AS chg FROM p{x} {W}),
d{x} AS (SELECT *, equity - greatest(max(equity) OVER w, 0) AS dd FROM e{x} {W})"""


@query("g6_mean_reversion_score", f"""WITH {reversion_sql(10, 0.2, 1.0)}
SELECT symbol, round(sum(pnl), 6) AS terminal, round(min(dd), 6) AS max_drawdown, count(*) FILTER (WHERE chg) AS trades,
  round(least(greatest(sum(pnl) + 0.5 * avg(pnl) / (stddev_pop(pnl) + 1e-9), -1), 2), 6) AS score FROM d GROUP BY symbol""")
def g6(t):
    out = SG.mean_reversion(t.ticks, t.by_symbol, lookback=10, threshold=0.2)
    return rnd(out.select("symbol", "terminal", "max_drawdown", "trades", "score"), "terminal", "max_drawdown", "score")


@query("g7_parameter_sweep", f"""
WITH {reversion_sql(10, 0.2, 1.0)}, a AS (SELECT symbol, least(greatest(sum(pnl) + 0.5 * avg(pnl) / (stddev_pop(pnl) + 1e-9), -1), 2) AS score FROM d GROUP BY symbol),
{reversion_sql(5, 0.4, 0.5, "2")},
b AS (SELECT symbol, least(greatest(sum(pnl) + 0.5 * avg(pnl) / (stddev_pop(pnl) + 1e-9), -1), 2) AS score FROM d2 GROUP BY symbol)
SELECT symbol, CAST(0 AS BIGINT) AS strategy, round(score, 6) AS score, NULL::VARCHAR AS error FROM a UNION ALL SELECT symbol, CAST(1 AS BIGINT), round(score, 6), NULL FROM b
UNION ALL SELECT DISTINCT symbol, CAST(2 AS BIGINT), NULL::DOUBLE, 'lookback must be positive' FROM ticks""")
def g7(t):
    grid = [{"lookback": 10, "threshold": 0.2, "budget": 1.0}, {"lookback": 5, "threshold": 0.4, "budget": 0.5}, {"lookback": 0, "threshold": 0.1, "budget": 1.0}]
    return rnd(SG.sweep(t.ticks, t.by_symbol, grid).select("symbol", "strategy", "score", "error"), "score")


def with_signal(t):
    return t.ticks.withColumn("signal", F.signum(F.col("price") - 50))


@query("g8_pnl_pipeline", f"""
WITH x AS (SELECT *, sign(price - 50) AS sg, price / lag(price) OVER w - 1 AS r FROM ticks {W}),
v AS (SELECT *, CASE WHEN count(r) OVER s > 1 THEN stddev_samp(r) OVER s END AS vol FROM x WINDOW s AS (PARTITION BY symbol ORDER BY ts, seq ROWS 9 PRECEDING)),
c AS (SELECT *, least(greatest(CASE WHEN vol > 1e-12 THEN least(greatest(sg, -0.8), 0.8) * 0.5 / vol ELSE least(greatest(sg, -0.8), 0.8) END, -0.8), 0.8) AS raw FROM v),
p AS (SELECT *, coalesce(lag(raw, 2) OVER w, 0) AS position FROM c {W}),
m AS (SELECT *, coalesce(lag(position) OVER w, 0) AS held, coalesce(price - lag(price) OVER w, 0) AS step FROM p {W}),
e AS (SELECT *, held * step - abs(position - held) * price * 5e-4 AS pnl FROM m), q AS (SELECT *, sum(pnl) OVER w AS equity FROM e {W})
SELECT seq, round(position, 6) + 0.0 AS position, round(pnl, 6) + 0.0 AS pnl, round(equity, 6) AS equity, round(equity - max(equity) OVER w, 6) AS drawdown FROM q {W}""")
def g8(t):
    out = SG.pnl_pipeline(with_signal(t), t.by_symbol, latency=2, max_gross=0.8, target_vol=0.5, lookback=10, cost_bps=5.0)
    return rnd(out.select("seq", "position", "pnl", "equity", "drawdown"), "position", "pnl", "equity", "drawdown")


@query("g9_simple_backtest", f"""
WITH x AS (SELECT *, coalesce((price - lag(price) OVER w) / lag(price) OVER w, 0) * sign(price - 50) AS pnl, sign(price - 50) <> sign(lag(price) OVER w - 50) AS chg FROM ticks {W}),
e AS (SELECT *, 1 + sum(pnl) OVER w AS e FROM x {W}), p AS (SELECT *, e / max(e) OVER w - 1 AS dd FROM e {W})
SELECT symbol, round(sum(pnl), 6) AS total_return, round(min(dd), 6) AS max_drawdown, count(*) FILTER (WHERE chg) AS trades FROM p GROUP BY symbol""")
def g9(t):
    return rnd(SG.simple_backtest(with_signal(t), t.by_symbol), "total_return", "max_drawdown")


COSTS = "(VALUES ('A', 0.01, 2.0, 0.0, 0.02, 0.0, 0.0, 0.001, 0.0, 0.0, 300.0, 500.0, 252.0, 1.0), ('N', 0.0, 5.0, 0.1, 0.0, 3.0, 0.01, 0.0, 0.0, 0.0, 200.0, 400.0, 252.0, 1.5), ('R', 0.0, 0.0, 0.2, 0.0, 1.0, 0.0, 0.0, 0.0001, 0.0002, 0.0, 100.0, 365.0, 1.0)) c(venue, fpu, cb, cp, sf, sb, slf, slu, sa, slb, lr, shr, per, ex)"


@query("g10_transaction_costs", rounded_twice(f"""
SELECT order_id, line, part, broker, round(quantity * fpu + quantity * price * (cb * 1e-4 + cp * 0.01), 6) AS commission, round(sf + price * sb * 1e-4, 11) AS spread,
  round(slf + quantity * slu + price * (sa + slb * sqrt(quantity)), 6) AS slippage, round(CASE WHEN status = 'F' THEN lr ELSE shr END * 1e-4 * quantity * price * pow(quantity, ex - 1) / per, 6) AS financing
FROM fills JOIN {COSTS} USING (venue)"""))
def g10(t):
    names = ["fee_per_unit", "commission_bps", "commission_percent", "spread_fixed", "spread_bps", "slippage_fixed", "slippage_per_unit", "slippage_a", "slippage_b",
             "long_rate_bps", "short_rate_bps", "periods", "exponent"]
    rows = [("A", 0.01, 2.0, 0.0, 0.02, 0.0, 0.0, 0.001, 0.0, 0.0, 300.0, 500.0, 252.0, 1.0), ("N", 0.0, 5.0, 0.1, 0.0, 3.0, 0.01, 0.0, 0.0, 0.0, 200.0, 400.0, 252.0, 1.5),
            ("R", 0.0, 0.0, 0.2, 0.0, 1.0, 0.0, 0.0, 0.0001, 0.0002, 0.0, 100.0, 365.0, 1.0)]
    costs = t.spark.createDataFrame(rows, "venue string, " + ", ".join(f"{n} double" for n in names))
    d = t.fills.withColumn("position", F.when(F.col("status") == "F", F.col("quantity")).otherwise(-F.col("quantity")))
    out = SG.trade_costs(d, costs, "venue", position="position")
    return rnd(rnd(out.select("order_id", "line", "part", "broker", "commission", "spread", "slippage", "financing"), "commission", "slippage", "financing", twice=True), "spread", digits=11, twice=True)


def curve(t):
    """Equity of each venue: start plus the running sum of centred prices; the benchmark is the volume's change."""
    d = running(t.ticks, t.by_venue, {"equity": ("sum", F.col("price") - 40)}).withColumn("equity", F.col("equity") + 100000)
    return windowed(d, t.by_venue, lambda x, w: x.withColumn("bench", F.col("volume") / 1e5), back=1)


EQ = """q AS (SELECT venue, ts, seq, 100000 + sum(price - 40) OVER w AS e, volume / 1e5 AS b FROM ticks WINDOW w AS (PARTITION BY venue ORDER BY ts, seq)),
r AS (SELECT *, e / coalesce(lag(e) OVER w, 100000) - 1 AS r, e - coalesce(lag(e) OVER w, 100000) AS pnl, max(e) OVER w AS peak FROM q WINDOW w AS (PARTITION BY venue ORDER BY ts, seq))"""


@query("g11_performance_report", f"""
WITH {EQ}, c AS (SELECT venue, quantile_cont(r, 0.05) AS cut FROM r GROUP BY 1)
SELECT venue, count(*) AS n, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe, round(avg(r) / stddev_samp(r) FILTER (WHERE r < 0) * sqrt(252), 6) AS sortino,
  round(expm1v, 4) AS certainty_equivalent, round(pow(arg_max(e, (ts, seq)) / 100000, 252.0 / count(*)) - 1, 6) AS cagr, round(min(e - peak), 4) AS max_drawdown,
  round(avg(r) FILTER (WHERE r <= cut), 9) AS expected_shortfall, round(count(*) FILTER (WHERE pnl > 0) / count(*) FILTER (WHERE abs(pnl) > 1e-12), 6) AS hit_ratio,
  round(covar_samp(r, b) / var_samp(b), 6) AS beta, round((avg(r) - covar_samp(r, b) / var_samp(b) * avg(b)) * 252, 6) AS alpha, round(stddev_samp(r - b), 9) AS tracking_error,
  round(avg(r - b) / stddev_samp(r - b) * sqrt(252), 6) AS information_ratio
FROM r JOIN c USING (venue) JOIN (SELECT venue, exp(252 * ln(1 + avg(r) - 0.5 * var_samp(r))) - 1 AS expm1v FROM r GROUP BY 1) USING (venue) GROUP BY venue, expm1v""")
def g11(t):
    out = PF.report(curve(t), t.by_venue, "equity", capital=100000.0, benchmark="bench")
    names = ["sharpe", "sortino", "cagr", "hit_ratio", "beta", "alpha", "information_ratio"]
    out = rnd(rnd(rnd(out.drop("psr", "sharpe_p"), *names), "certainty_equivalent", "max_drawdown", digits=4), "expected_shortfall", "tracking_error", digits=9)
    return out


@query("g11_sharpe_significance")
def g11p(t):
    return PF.report(curve(t), t.by_venue, "equity", capital=100000.0).select("venue", "psr", "sharpe_p")


@query("g12_bootstrap_intervals")
def g12(t):
    return PF.bootstrap(curve(t), t.by_venue, "equity", capital=100000.0)


BASE = """b AS (SELECT venue, ts, seq, epoch_us(ts) - epoch_us(min(ts) OVER v) AS o, epoch_us(max(ts) OVER v) - epoch_us(min(ts) OVER v) AS span, row_number() OVER w AS pos, count(*) OVER v AS n
  FROM ticks WINDOW v AS (PARTITION BY venue), w AS (PARTITION BY venue ORDER BY ts, seq))"""
WF = BASE + """, f AS (SELECT unnest(range(0, 40)) AS fold), D AS (SELECT 86400000000 AS day),
m AS (SELECT venue, ts, seq, pos, n, fold, CASE WHEN o >= (7 + 3 * fold) * day THEN 'test' ELSE 'train' END AS role FROM b, f, D WHERE (7 + 3 * fold + 3) * day <= span
  AND o >= 3 * fold * day AND o < (7 + 3 * fold + 3) * day),
x AS (SELECT venue, fold, min(ts) AS t0, max(ts + INTERVAL 12 HOURS) AS t1, max(pos) AS last FROM m WHERE role = 'test' GROUP BY 1, 2),
s AS (SELECT m.* FROM m JOIN x USING (venue, fold) WHERE role = 'test' OR NOT (ts + INTERVAL 12 HOURS >= t0 AND ts <= t1) AND NOT (pos > last AND pos <= last + ceil(n * 0.01)))"""


def labelled(t):
    return t.ticks.withColumn("label_end", F.col("ts") + F.expr("interval 12 hours"))


@query("g14_walk_forward", f"WITH {WF} SELECT venue, fold, role, seq FROM s")
def g14(t):
    return FO.walk_forward(labelled(t), t.by_venue, train=7 * DAY, test=3 * DAY, label_end="label_end", embargo=0.01).select("venue", "fold", "role", "seq")


@query("g15_purged_kfold", "WITH " + BASE + """, f AS (SELECT unnest(range(0, 5)) AS fold), o AS (SELECT *, ntile(5) OVER (PARTITION BY venue ORDER BY pos) - 1 AS own FROM b),
m AS (SELECT venue, ts, seq, pos, n, fold, CASE WHEN fold = own THEN 'test' ELSE 'train' END AS role FROM o, f),
x AS (SELECT venue, fold, min(ts) AS t0, max(ts + INTERVAL 12 HOURS) AS t1, max(pos) AS last FROM m WHERE role = 'test' GROUP BY 1, 2)
SELECT venue, fold, role, seq FROM m JOIN x USING (venue, fold) WHERE role = 'test' OR NOT (ts + INTERVAL 12 HOURS >= t0 AND ts <= t1) AND NOT (pos > last AND pos <= last + ceil(n * 0.02))""")
def g15(t):
    return FO.purged_kfold(labelled(t), t.by_venue, 5, label_end="label_end", embargo=0.02).select("venue", "fold", "role", "seq")


def learning(t):
    def build(d, w):
        return d.withColumn("x", pct_change("price", w)).withColumn("target", F.lead("volume").over(w) / 100 - 0.5)
    return windowed(t.ticks, t.by_venue, build, back=1, fwd=1)


def splits(t):
    return FO.walk_forward(learning(t), t.by_venue, train=7 * DAY, test=3 * DAY)


@query("g16_linear_model_folds", f"""
WITH {BASE}, f AS (SELECT unnest(range(0, 40)) AS fold), D AS (SELECT 86400000000 AS day),
y AS (SELECT seq, price / lag(price) OVER w - 1 AS x, lead(volume) OVER w / 100 - 0.5 AS y FROM ticks WINDOW w AS (PARTITION BY venue ORDER BY ts, seq)),
m AS (SELECT venue, fold, x, y, CASE WHEN o >= (7 + 3 * fold) * day THEN 'test' ELSE 'train' END AS role FROM b JOIN y USING (seq), f, D WHERE (7 + 3 * fold + 3) * day <= span
  AND o >= 3 * fold * day AND o < (7 + 3 * fold + 3) * day AND x IS NOT NULL AND y IS NOT NULL),
c AS (SELECT venue, fold, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM m WHERE role = 'train' GROUP BY 1, 2),
p AS (SELECT venue, fold, y, i + s * x AS p, sign(i + s * x) * y AS ret FROM m JOIN c USING (venue, fold) WHERE role = 'test')
SELECT venue, fold, round(avg(CASE WHEN sign(p) = sign(y) THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(avg(ret) / stddev_samp(ret), 6) AS sharpe_ratio, round(sum(ret), 6) AS total_pnl,
  round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(1 - sum((y - p) ** 2) / (count(*) * var_pop(y)), 6) AS r2 FROM p GROUP BY 1, 2""")
def g16(t):
    names = ["hit_rate", "sharpe_ratio", "total_pnl", "mae", "rmse", "r2"]
    return rnd(FO.evaluate_linear(splits(t), ["venue"], ["x"], "target").select("venue", "fold", *names), *names)


@query("g16_model_selection")
def g16b(t):
    s = learning(t).withColumn("all", F.lit("all"))
    folds = FO.walk_forward(s, Axis(("all",), "ts", ("seq",)), train=15 * DAY, test=7 * DAY)
    return FO.mean_over_folds(FO.evaluate_models(folds, ["x", "volume"], "target"), ["model"])


@query("g16_ridge_folds", f"""
WITH {BASE}, f AS (SELECT unnest(range(0, 40)) AS fold), D AS (SELECT 86400000000 AS day),
y AS (SELECT seq, price / lag(price) OVER w - 1 AS x, lead(volume) OVER w / 100 - 0.5 AS y FROM ticks WINDOW w AS (PARTITION BY venue ORDER BY ts, seq)),
m AS (SELECT venue, fold, x, y, CASE WHEN o >= (7 + 3 * fold) * day THEN 'test' ELSE 'train' END AS role FROM b JOIN y USING (seq), f, D WHERE (7 + 3 * fold + 3) * day <= span
  AND o >= 3 * fold * day AND o < (7 + 3 * fold + 3) * day AND x IS NOT NULL AND y IS NOT NULL),
c AS (SELECT venue, fold, regr_sxy(y, x) / (regr_sxx(y, x) + 1) AS s, avg(y) - regr_sxy(y, x) / (regr_sxx(y, x) + 1) * avg(x) AS i FROM m WHERE role = 'train' GROUP BY 1, 2)
SELECT venue, fold, round(avg(abs(y - i - s * x)), 6) AS mae, round(sqrt(avg((y - i - s * x) ** 2)), 6) AS rmse FROM m JOIN c USING (venue, fold) WHERE role = 'test' GROUP BY 1, 2""")
def g16c(t):
    return rnd(FO.evaluate_linear(splits(t), ["venue"], ["x"], "target", 1.0).select("venue", "fold", "mae", "rmse"), "mae", "rmse")


@query("g17_sharpe_objective", f"WITH {EQ} SELECT venue, round(avg(r) / stddev_samp(r), 6) AS sharpe FROM r GROUP BY venue")
def g17(t):
    d = windowed(curve(t), t.by_venue, lambda x, w: x.withColumn("r", F.col("equity") / F.coalesce(F.lag("equity").over(w), F.lit(100000.0)) - 1), back=1)
    return d.groupBy("venue").agg(F.round(SG.sharpe("r"), 6).alias("sharpe"))


@query("g18_shadow_evaluation", """
WITH a AS (SELECT seq, venue, ts, sign(price - 50) AS ba, sign(price - 55) AS ca, least(price / 200, 1) AS bc, least(price / 190, 1) AS cc FROM ticks),
s AS (SELECT *, count(*) OVER w AS n, avg(CASE WHEN ba <> ca THEN 1.0 ELSE 0 END) OVER w AS dis, avg(abs(cc - bc) / greatest(bc, 1e-6)) OVER w AS mape, abs(avg(ca) OVER w - avg(ba) OVER w) AS drift FROM a
  WINDOW w AS (PARTITION BY venue ORDER BY ts, seq ROWS 49 PRECEDING)),
k AS (SELECT *, dis <= 0.1 AND mape <= 0.2 AND drift <= 0.1 AS ok, row_number() OVER (PARTITION BY venue ORDER BY ts, seq) AS rn FROM s),
z AS (SELECT *, rn - coalesce(max(CASE WHEN NOT ok THEN rn END) OVER (PARTITION BY venue ORDER BY ts, seq), 0) AS stable FROM k)
SELECT seq, round(dis, 6) AS disagreement_rate, round(mape, 6) AS confidence_mape, round(drift, 6) AS action_drift, stable AS stable_rows,
  CASE WHEN n >= 10 AND NOT (dis <= 0.5 AND mape <= 1 AND drift <= 0.5) THEN 'reject' WHEN n >= 10 AND stable >= 20 THEN 'promote' ELSE 'continue' END AS decision FROM z""")
def g18(t):
    p = F.col("price")
    d = t.ticks.select("venue", "ts", "seq", F.signum(p - 50).alias("baseline_action"), F.signum(p - 55).alias("candidate_action"),
                       F.least(p / 200, F.lit(1.0)).alias("baseline_confidence"), F.least(p / 190, F.lit(1.0)).alias("candidate_confidence"))
    names = ["disagreement_rate", "confidence_mape", "action_drift"]
    return rnd(SG.shadow_report(d, t.by_venue).select("seq", *names, "stable_rows", "decision"), *names)


@query("g19_canary_guard", """
WITH p AS (SELECT seq, venue, ts, price, sum(price - 45) OVER w AS pnl, row_number() OVER w AS rn FROM ticks WINDOW w AS (PARTITION BY venue ORDER BY ts, seq)),
h AS (SELECT *, greatest(max(pnl) OVER (PARTITION BY venue ORDER BY ts, seq), 0) AS hw FROM p)
SELECT seq, round(CASE WHEN hw = 0 THEN 0 ELSE greatest(0, (hw - pnl) / greatest(hw, 1e-6)) END, 6) AS drawdown, rn <= 5 AS grace,
  concat_ws(',', CASE WHEN hw > 0 AND (hw - pnl) / greatest(hw, 1e-6) >= 0.05 THEN 'drawdown' END, CASE WHEN price > 200 THEN 'price' END) AS breaches FROM h""")
def g19(t):
    d = running(t.ticks, t.by_venue, {"pnl": ("sum", F.col("price") - 45)})
    out = SG.canary_guard(d, t.by_venue, limits={"price": (None, 200.0)}, cooldown=3600.0)
    return out.select("seq", F.round("drawdown", 6).alias("drawdown"), (F.col("reason") == "grace-period").alias("grace"), F.array_join("breaches", ",").alias("breaches"))


@query("g19_canary_decisions")
def g19b(t):
    d = running(t.ticks, t.by_venue, {"pnl": ("sum", F.col("price") - 45)})
    out = SG.canary_guard(d, t.by_venue, limits={"price": (None, 200.0)}, cooldown=86400.0)
    return out.groupBy("venue", "decision", "reason").agg(F.count(F.lit(1)).alias("rows"))


@query("g20_environment_parity", """
WITH m AS (SELECT symbol AS run, venue AS environment, metric, value FROM (SELECT symbol, venue, 'mean' AS metric, avg(price) AS value FROM ticks GROUP BY 1, 2
  UNION ALL SELECT symbol, venue, 'peak', max(price) FROM ticks WHERE volume > 50 GROUP BY 1, 2)),
g AS (SELECT symbol AS run, venue AS environment, max(price) > 250 AS digest FROM ticks GROUP BY 1, 2),
e AS (SELECT run, 3 - count(*) FILTER (WHERE environment IN ('click', 'view', 'staging')) AS missing_environments, count(DISTINCT digest) AS digests, count(*) AS n FROM g GROUP BY 1),
k AS (SELECT run, sum(n - c) AS missing_metrics FROM (SELECT run, metric, count(*) AS c FROM m GROUP BY 1, 2) JOIN e USING (run) GROUP BY run),
p AS (SELECT a.run, count(*) FILTER (WHERE abs(b.value - a.value) > CASE a.metric WHEN 'mean' THEN 60 ELSE 150 END) AS deviations, max(abs(b.value - a.value)) AS mx
  FROM m a JOIN m b ON a.run = b.run AND a.metric = b.metric AND a.environment < b.environment GROUP BY 1)
SELECT run, CAST(missing_environments AS BIGINT) AS missing_environments, CAST(digests AS BIGINT) AS digests, CAST(missing_metrics AS BIGINT) AS missing_metrics, deviations, round(mx, 6) AS max_deviation,
  CASE WHEN missing_environments + missing_metrics + deviations > 0 THEN 'fail' WHEN digests > 1 THEN 'drift' ELSE 'pass' END AS status FROM e JOIN k USING (run) JOIN p USING (run)""")
def g20(t):
    g = t.ticks.groupBy(F.col("symbol").alias("run"), F.col("venue").alias("environment"))
    mean = g.agg(F.avg("price").alias("value")).withColumn("metric", F.lit("mean"))
    peak = t.ticks.filter("volume > 50").groupBy(F.col("symbol").alias("run"), F.col("venue").alias("environment")).agg(F.max("price").alias("value")).withColumn("metric", F.lit("peak"))
    digests = g.agg((F.max("price") > 250).cast("string").alias("digest"))
    out = SG.environment_parity(mean.unionByName(peak), digests, run=["run"], required=["click", "view", "staging"], tolerances={"mean": 60.0}, default_tolerance=150.0)
    return out.withColumn("max_deviation", F.round("max_deviation", 6))
