"""Attribution, tail risk, drift, text sentiment, budgets."""

from pyspark.sql import functions as F

from tickloom.functions.exprs import micros
from tickloom.operators import risk as R
from tickloom.operators.axis import Axis, windowed
from tickloom.operators.windows import pct_change
from tickloom.plans.aggregates import rnd
from tickloom.plans.registry import query, rounded_twice

DAY = 86400.0
BY_NAME = Axis(("name",), "date", (), grain=DAY)


@query("r1_factor_attribution", """
WITH p AS (SELECT name, sum(pnl * 0.01 * (1 + day(date) % 3)) AS v FROM strategy_pnl GROUP BY name)
SELECT name, round(v, 3) AS total, round(v / sum(v) OVER (), 6) AS share, round(abs(v) / sum(abs(v)) OVER (), 6) AS abs_share FROM p""")
def r1(t):
    e = t.strategy_pnl.select("date", "name", F.col("pnl").alias("exposure"))
    ret = t.strategy_pnl.select("date", "name", (0.01 * (1 + F.dayofmonth("date") % 3)).alias("ret"))
    return rnd(rnd(R.factor_attribution(e, ret, ["date"]), "share", "abs_share"), "total", digits=3)


SHARES = "s AS (SELECT name, avg(abs(pnl)) AS m FROM strategy_pnl GROUP BY 1), h AS (SELECT name, m, m / sum(m) OVER () AS share FROM s)"


@query("r2_exposure_shares", f"WITH {SHARES} SELECT name, round(m, 4) AS mean_abs, round(share, 6) AS share FROM h")
def r2(t):
    return rnd(rnd(R.exposure_shares(t.strategy_pnl, "name", "pnl"), "share"), "mean_abs", digits=4)


@query("r3_concentration_alerts", f"WITH {SHARES} SELECT name, round(share, 6) AS share, CASE WHEN share >= 0.27 THEN 'critical' WHEN share >= 0.198 THEN 'warning' ELSE 'info' END AS severity FROM h WHERE share > 0.18")
def r3(t):
    return rnd(R.concentration_alerts(R.exposure_shares(t.strategy_pnl, "name", "pnl"), 0.18).select("name", "share", "severity"), "share")


@query("r4_hedge_effectiveness", "SELECT venue, round(covar_pop(price, volume) / var_pop(volume), 6) AS beta, round(corr(price, volume) ** 2, 6) AS effectiveness, round(corr(price, volume), 6) AS correlation FROM ticks GROUP BY venue")
def r4(t):
    return rnd(R.hedge_effectiveness(t.ticks, ["venue"], "price", "volume"), "beta", "effectiveness", "correlation")


@query("r5_regime_stability", """
WITH p AS (SELECT name, avg(pnl) AS m, stddev_pop(pnl) AS v, count(*) AS n FROM strategy_pnl GROUP BY 1)
SELECT name, round(m, 4) AS mean, round(v, 4) AS vol, n, round(m / v, 6) AS sharpe, round(stddev_pop(m) OVER (), 4) AS dispersion FROM p""")
def r5(t):
    return rnd(rnd(R.regime_stability(t.strategy_pnl, "name", "pnl"), "mean", "vol", "dispersion", digits=4), "sharpe")


TAIL = """l AS (SELECT name, CASE WHEN count(*) OVER w = 5 THEN -sum(pnl) OVER w END AS x FROM strategy_pnl WINDOW w AS (PARTITION BY name ORDER BY date ROWS 4 PRECEDING)),
v AS (SELECT name, quantile_cont(x, 0.95) AS v, count(*) AS n FROM l WHERE x IS NOT NULL GROUP BY 1), tr AS (SELECT name, v, n, avg(x) AS es FROM l JOIN v USING (name) WHERE x >= v GROUP BY 1, 2, 3)"""


@query("r6_tail_risk", f"WITH {TAIL} SELECT name, round(v, 3) AS var, round(es, 3) AS es, n FROM tr")
def r6(t):
    return rnd(R.tail_risk(t.strategy_pnl, BY_NAME, "pnl", horizon=5), "var", "es", digits=3)


SHOCKS = [("crash", "BUILDING", -0.3), ("crash", "MACHINERY", -0.2), ("crash", "NOWHERE", -0.5), ("boom", "HOUSEHOLD", 0.1)]


@query("r7_shock_scenarios", """
WITH s(scenario, asset, shock) AS (VALUES ('crash', 'BUILDING', -0.3), ('crash', 'MACHINERY', -0.2), ('crash', 'NOWHERE', -0.5), ('boom', 'HOUSEHOLD', 0.1))
SELECT scenario, round(coalesce(sum(amount * shock), 0), 3) AS impact, count(*) FILTER (WHERE amount IS NULL) AS missing_assets, round(coalesce(sum(amount * shock), 0) / (SELECT sum(abs(amount)) FROM exposures), 6) AS relative
FROM s LEFT JOIN exposures USING (asset) GROUP BY scenario""")
def r7(t):
    s = t.spark.createDataFrame(SHOCKS, "scenario string, asset string, shock double")
    return rnd(rnd(R.shock_scenarios(t.exposures, s), "relative"), "impact", digits=3)


@query("r8_volatility_scenarios", f"WITH {TAIL} SELECT name, n, scenario, round(v * m, 3) AS var, round(es * m, 3) AS es, v * m > 500000 AS breach FROM tr, (VALUES ('calm', 0.5), ('stress', 2.0)) s(scenario, m)")
def r8(t):
    return rnd(R.volatility_scenarios(R.tail_risk(t.strategy_pnl, BY_NAME, "pnl", horizon=5), {"calm": 0.5, "stress": 2.0}, 500000.0), "var", "es", digits=3)


POS, NEG, BOOST = ["the", "on", "is"], ["and", "or", "le"], ["in"]
BAG = lambda w: "len(list_filter(ws, lambda x: x IN (" + ", ".join(f"'{x}'" for x in w) + ")))"
SENT = f"""w AS (SELECT doc_id, ts, source, regexp_extract_all(lower(headline), '([\\p{{L}}'']+)', 1) AS ws FROM news),
sc AS (SELECT doc_id, ts, source, greatest(least(coalesce(({BAG(POS)} - {BAG(NEG)}) / nullif({BAG(POS)} + {BAG(NEG)}, 0), 0) * CASE WHEN {BAG(BOOST)} > 0 THEN 1.5 ELSE 1 END, 1), -1) AS s FROM w)"""


def scored(t):
    return t.news.withColumn("s", R.sentiment(F.col("headline"), POS, NEG, BOOST))


@query("d1_text_sentiment", f"WITH {SENT} SELECT doc_id, round(s, 6) AS s FROM sc")
def d1(t):
    return rnd(scored(t).select("doc_id", "s"), "s")


@query("d2_news_bins", f"""WITH {SENT}, b AS (SELECT source, time_bucket(INTERVAL '2 hours', ts) AS ts, count(*) AS c, avg(s) AS m, stddev_samp(s) AS d FROM sc GROUP BY 1, 2),
g AS (SELECT source, unnest(generate_series(min(ts), max(ts), INTERVAL '2 hours')) AS ts FROM b GROUP BY 1)
SELECT source, epoch_us(ts) AS ts, coalesce(c, 0) AS count, round(coalesce(m, 0), 6) AS mean, round(coalesce(d, 0), 6) AS std FROM g LEFT JOIN b USING (source, ts)""")
def d2(t):
    d = R.text_bins(scored(t), ["source"], "ts", 7200.0, "s", "lang")
    return rnd(d.select("source", micros("ts").alias("ts"), "count", "mean", "std"), "mean", "std")


@query("d3_sentiment_bins", f"""WITH {SENT}, b AS (SELECT lang, time_bucket(INTERVAL '1 hour', sc.ts) AS ts, sum(s * n_chars) / sum(n_chars) AS v, count(DISTINCT sc.source) AS k FROM sc JOIN news USING (doc_id) GROUP BY 1, 2)
SELECT lang, epoch_us(ts) AS ts, round(v, 6) AS score, k AS sources, round(v - lag(v) OVER (PARTITION BY lang ORDER BY ts), 6) AS momentum FROM b""")
def d3(t):
    d = R.weighted_bins(scored(t), Axis(("lang",), "ts", ("doc_id",)), 3600.0, "s", "n_chars", "source")
    return rnd(d.select("lang", micros("ts").alias("ts"), "score", "sources", "momentum"), "score", "momentum")


VENUES = ("click", "error", "purchase", "signup", "view")


@query("d4_wide_metrics", f"""
WITH b AS (SELECT symbol, time_bucket(INTERVAL '1 day', ts) AS ts, {", ".join(f"avg(price) FILTER (WHERE venue = '{v}') AS {v}" for v in VENUES)} FROM ticks GROUP BY 1, 2),
g AS (SELECT symbol, unnest(generate_series(min(ts), max(ts), INTERVAL '1 day')) AS ts FROM b GROUP BY 1),
f AS (SELECT symbol, ts, {", ".join(f"last_value({v} IGNORE NULLS) OVER w AS {v}" for v in VENUES)} FROM g LEFT JOIN b USING (symbol, ts) WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, epoch_us(ts) AS ts, {", ".join(f"round({v}, 6) AS {v}, round({v} - lag({v}) OVER w, 6) AS {v}_delta, round(stddev_samp({v}) OVER s, 6) AS {v}_vol" for v in VENUES)} FROM f
WINDOW w AS (PARTITION BY symbol ORDER BY ts), s AS (PARTITION BY symbol ORDER BY ts ROWS 6 PRECEDING)""")
def d4(t):
    d = R.wide_metrics(t.ticks, t.by_symbol, DAY, "venue", "price", list(VENUES))
    names = [n for v in VENUES for n in (v, f"{v}_delta", f"{v}_vol")]
    return rnd(d.select("symbol", micros("ts").alias("ts"), *names), *names)


@query("d5_fusion", """
WITH m AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS h, arg_max(price, (ts, seq)) AS p FROM ticks GROUP BY 1), n AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS h, max(n_chars) AS c FROM news GROUP BY 1)
SELECT epoch_us(h) AS ts, p AS market_price, CAST(c AS DOUBLE) AS news_chars FROM m FULL JOIN n USING (h)""")
def d5(t):
    from tickloom.operators.joins import concat_columns
    hour = F.window("ts", "1 hour").start.alias("ts")
    out = concat_columns({"market": t.ticks.groupBy(hour).agg(F.max_by("price", F.struct("ts", "seq")).alias("price")),
                          "news": t.news.groupBy(hour).agg(F.max("n_chars").cast("double").alias("chars"))}, ["ts"])
    return out.withColumn("ts", micros("ts"))


def halves(t):
    early = F.col("seq") % 2 == 0
    return t.ticks.filter(early), t.ticks.filter(~early)


def psi(table: str, key: str, column: str) -> str:
    """(key, psi) of a table with a column ``half`` (0: reference) as in ``risk.psi``."""
    return f"""SELECT g.{key}, sum((c - r) * ln(c / r)) AS psi FROM (
  SELECT e.{key}, e.b, greatest(coalesce(count(*) FILTER (WHERE half = 0), 0) / any_value(e.n0), 1e-6) AS r, greatest(coalesce(count(*) FILTER (WHERE half = 1), 0) / any_value(e.n1), 1e-6) AS c
  FROM (SELECT {key}, e, n0, n1, unnest(range(0, len(e) - 1)) AS b FROM (SELECT {key}, list_sort(list_distinct(quantile_cont({column}, [{", ".join(str(i / 10) for i in range(11))}]) FILTER (WHERE half = 0))) AS e,
    count(*) FILTER (WHERE half = 0) AS n0, count(*) FILTER (WHERE half = 1) AS n1 FROM {table} GROUP BY {key})) e
  LEFT JOIN {table} x ON x.{key} = e.{key} AND x.{column} BETWEEN e.e[1] AND e.e[len(e.e)] AND least(len(list_filter(e.e, lambda v: v <= x.{column})) - 1, len(e.e) - 2) = e.b GROUP BY 1, 2) g GROUP BY 1"""


@query("d6_psi", f"WITH h AS (SELECT *, seq % 2 AS half FROM ticks), p AS ({psi('h', 'venue', 'price')}) SELECT venue, round(psi, 6) AS psi FROM p")
def d6(t):
    return rnd(R.psi(*halves(t), ["venue"], "price"), "psi")


@query("d7_ks_statistic", """
WITH r AS (SELECT venue, price, count(*) FILTER (WHERE seq % 2 = 0) AS a, count(*) FILTER (WHERE seq % 2 = 1) AS b FROM ticks GROUP BY 1, 2),
c AS (SELECT venue, sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p AS d FROM r WINDOW w AS (PARTITION BY venue ORDER BY price), p AS (PARTITION BY venue))
SELECT venue, round(max(abs(d)), 6) AS ks FROM c GROUP BY venue""")
def d7(t):
    return rnd(R.ks(*halves(t), ["venue"], "price").select("venue", "ks"), "ks")


@query("d8_drift_summary", f"""
WITH h AS (SELECT 'price' AS feature, price AS value, seq % 2 AS half FROM ticks UNION ALL SELECT 'volume', volume, seq % 2 FROM ticks), p AS ({psi('h', 'feature', 'value')}),
c AS (SELECT feature, value, count(*) FILTER (WHERE half = 0) AS a, count(*) FILTER (WHERE half = 1) AS b FROM h GROUP BY 1, 2),
k AS (SELECT feature, max(abs(d)) AS ks, any_value(na) AS n_ref, any_value(nb) AS n_cur FROM (SELECT feature, sum(a) OVER w / sum(a) OVER f - sum(b) OVER w / sum(b) OVER f AS d, sum(a) OVER f AS na, sum(b) OVER f AS nb
  FROM c WINDOW w AS (PARTITION BY feature ORDER BY value), f AS (PARTITION BY feature)) GROUP BY 1),
l AS (SELECT *, (sqrt(n_ref * n_cur / (n_ref + n_cur)) + 0.12 + 0.11 / sqrt(n_ref * n_cur / (n_ref + n_cur))) * ks AS lam FROM k),
s AS (SELECT feature, psi, ks, n_ref, n_cur, CASE WHEN lam < 0.2 THEN 1 ELSE least(greatest(list_sum(list_transform(range(1, 31), lambda j: 2 * (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * j * j * lam * lam))), 0), 1) END AS p FROM l JOIN p USING (feature))
SELECT feature, round(psi, 6) AS psi, round(ks, 6) AS ks, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_cur AS BIGINT) AS n_cur, round(p, 6) AS p,
  CASE WHEN psi / 0.2 >= 2 THEN 'critical' WHEN psi / 0.2 >= 1 THEN 'major' WHEN psi / 0.2 >= 0.75 THEN 'warning' ELSE 'none' END AS psi_severity,
  CASE WHEN (1 - p) / 0.95 >= 2 THEN 'critical' WHEN (1 - p) / 0.95 >= 1 THEN 'major' WHEN (1 - p) / 0.95 >= 0.75 THEN 'warning' ELSE 'none' END AS ks_severity, psi >= 0.2 OR p < 1 - 0.95 AS drifted FROM s""")
def d8(t):
    return rnd(R.drift_summary(*halves(t), ["price", "volume"]), "psi", "ks", "p")


@query("d9_guardrails", """
WITH m AS (SELECT symbol, avg(price) AS v FROM ticks GROUP BY 1), b AS (SELECT symbol, v, CASE WHEN v < 45 THEN 45.0 WHEN v > 60 THEN 60.0 END AS x FROM m), d AS (SELECT *, abs(v - x) / x AS g FROM b WHERE x IS NOT NULL)
SELECT symbol, round(g, 6) AS distance, CASE WHEN g >= 0.5 THEN 'critical' WHEN g >= 0.2 THEN 'major' ELSE 'warning' END AS severity FROM d""")
def d9(t):
    m = t.ticks.groupBy("symbol").agg(F.avg("price").alias("value")).withColumn("metric", F.lit("mean"))
    b = t.spark.createDataFrame([("mean", 45.0, 60.0)], "metric string, low double, high double")
    return rnd(R.guardrails(m, b).select("symbol", "distance", "severity"), "distance")


@query("d10_retraining", """
SELECT seq, count(*) OVER w AS events, len(list_distinct(list(symbol) OVER w)) AS features FROM ticks WHERE price > 60 WINDOW w AS (PARTITION BY venue ORDER BY ts RANGE BETWEEN INTERVAL 4 HOURS PRECEDING AND CURRENT ROW)""")
def d10(t):
    return R.retraining(t.ticks.filter("price > 60"), t.by_venue, "symbol", span=14400.0).select("seq", "events", F.col("features").cast("long").alias("features"))


@query("d11_cost_advice", rounded_twice("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS k FROM ticks)
SELECT symbol, round(avg(volume) / 100, 6) AS utilisation, max(price) FILTER (WHERE k = 1) AS latest, round(quantile_cont(price, 0.5) FILTER (WHERE k > 1), 6) AS median FROM r GROUP BY symbol"""))
def d11(t):
    d = R.cost_advice(t.ticks.withColumn("u", F.col("volume") / 100), ["symbol"], ["ts", "seq"], cost="price", utilisation="u")
    return rnd(d.select("symbol", "utilisation", "latest", "median"), "utilisation", "median", twice=True)


@query("d12_budget_alerts", """
WITH u AS (SELECT symbol, seq, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS k, sum(price) OVER (PARTITION BY symbol ORDER BY ts RANGE INTERVAL 7 DAY PRECEDING) / 1000.0 AS used FROM ticks),
m AS (SELECT *, max(CASE WHEN used < 0.8 * 0.8 THEN k END) OVER w AS armed, max(CASE WHEN used >= 0.8 THEN k END) OVER w AS low, max(CASE WHEN used >= 1 THEN k END) OVER w AS high FROM u
  WINDOW w AS (PARTITION BY symbol ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT symbol, seq, round(used, 6) AS used, CASE WHEN used >= 0.8 AND (low IS NULL OR low < armed) THEN 1 ELSE 0 END + CASE WHEN used >= 1 AND (high IS NULL OR high < armed) THEN 1 ELSE 0 END AS crossed FROM m""")
def d12(t):
    return R.budget_alerts(t.ticks, t.by_symbol, "price", period=7 * DAY, limit=1000.0).select("symbol", "seq", F.round("used", 6).alias("used"), F.size("crossed").alias("crossed"))


@query("d13_slo_alerts", """
WITH RECURSIVE r AS (SELECT venue, seq, ts, avg(CASE WHEN price > 100 THEN 1.0 ELSE 0 END) OVER w AS error_rate, quantile_cont(volume, 0.95) OVER w AS p95 FROM ticks WINDOW w AS (PARTITION BY venue ORDER BY ts RANGE INTERVAL 4 HOUR PRECEDING)),
h AS (SELECT venue, seq, epoch_us(ts) AS us, row_number() OVER (PARTITION BY venue ORDER BY ts, seq) AS k FROM r WHERE error_rate > 0.2 OR p95 > 95),
f AS (SELECT venue, seq, k, us AS last, true AS alert FROM h WHERE k = 1 UNION ALL SELECT h.venue, h.seq, h.k, CASE WHEN h.us - f.last >= 600000000 THEN h.us ELSE f.last END, h.us - f.last >= 600000000 FROM f JOIN h ON h.venue = f.venue AND h.k = f.k + 1)
SELECT r.venue, r.seq, round(error_rate, 6) AS error_rate, round(p95, 6) AS p95, error_rate > 0.2 OR p95 > 95 AS breach, coalesce(f.alert, false) AS alert FROM r LEFT JOIN f ON f.venue = r.venue AND f.seq = r.seq""")
def d13(t):
    return rnd(R.slo_alerts(t.ticks, t.by_venue, F.col("price") > 100, "volume", span=14400.0, error_limit=0.2, latency_limit=95.0).select("venue", "seq", "error_rate", "p95", "breach", "alert"), "error_rate", "p95")


@query("d14_fingerprint", """SELECT seq, sha256('{"seq":' || seq || ',"symbol":"' || symbol || '","trace":' || CASE WHEN seq % 3 = 0 THEN 'null' ELSE '"t' || seq % 10 || '"' END || ',"venue":"' || venue || '"}') AS print FROM ticks""")
def d14(t):
    d = t.ticks.select("venue", "symbol", "seq", F.when(F.col("seq") % 3 != 0, F.concat(F.lit("t"), F.col("seq") % 10)).alias("trace"))
    return d.select("seq", R.fingerprint(d, d.columns).alias("print"))


@query("r6_asset_tail_risk", """
WITH r AS (SELECT asset, price / lag(price) OVER (PARTITION BY asset ORDER BY ts) - 1 AS r FROM asset_prices), v AS (SELECT asset, quantile_cont(-r, 0.99) AS v FROM r WHERE r IS NOT NULL GROUP BY 1)
SELECT asset, round(v, 6) AS var, round(avg(-r), 6) AS es FROM r JOIN v USING (asset) WHERE -r >= v GROUP BY 1, 2, asset, v""")
def r6b(t):
    d = windowed(t.asset_prices, t.by_asset, lambda x, w: x.withColumn("r", pct_change("price", w)), back=1).filter("r IS NOT NULL")
    return rnd(R.tail_risk(d, t.by_asset, "r", confidence=0.99).select("asset", "var", "es"), "var", "es")
