"""Entropy, scaling, synchrony, graph and regime indicators."""

from pyspark.sql import functions as F

from tickloom.operators import amm as AM
from tickloom.operators import entropy as E
from tickloom.operators import graph as G
from tickloom.operators import phase as P
from tickloom.operators import regime as RG
from tickloom.operators import windows as WI
from tickloom.plans.aggregates import rnd
from tickloom.plans.registry import query



def entropy_sql(src, key, x, bins):
    return f"""SELECT {key}, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM (SELECT {key}, least(CAST(floor(({x} - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1}) AS b, count(*) AS c
  FROM (SELECT *, min({x}) OVER k AS lo, max({x}) OVER k AS hi FROM {src} WINDOW k AS (PARTITION BY {key})) GROUP BY {key}, b) GROUP BY {key}"""


@query("i3_entropy", f"SELECT symbol, round(h, 6) AS entropy FROM ({entropy_sql('ticks', 'symbol', 'price', 30)})")
def entropy(t):
    return rnd(E.entropy(t.ticks, ["symbol"], "price", 30), "entropy")


@query("i4_delta_entropy", f"""
WITH r AS (SELECT symbol, price, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, seq DESC) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM ticks),
a AS (SELECT symbol || CASE WHEN k <= 30 THEN ':1' ELSE ':0' END AS g, price FROM r WHERE k <= 60 AND n >= 60), e AS ({entropy_sql('a', 'g', 'price', 10)}),
d AS (SELECT split_part(g, ':', 1) AS symbol, sum(CASE WHEN g LIKE '%:1' THEN h ELSE -h END) AS v FROM e GROUP BY 1)
SELECT symbol, round(coalesce(v, 0), 6) AS delta_entropy FROM (SELECT DISTINCT symbol FROM ticks) LEFT JOIN d USING (symbol)""")
def delta(t):
    return rnd(E.delta_entropy(t.ticks, t.by_symbol, "price", 30), "delta_entropy")


LAGS = ", ".join(f"stddev_pop(x - lag{k}) AS t{k}" for k in range(2, 11))
LAGX = ", ".join(f"lag(x, {k}) OVER w AS lag{k}" for k in range(2, 11))
UNP = " UNION ALL ".join(f"SELECT vec_id, ln({k}) AS lx, ln(t{k}) AS ly FROM s" for k in range(2, 11))


@query("i5_hurst", f"""
WITH l AS (SELECT vec_id, x, {LAGX} FROM multi_series WINDOW w AS (PARTITION BY vec_id ORDER BY pos)), s AS (SELECT vec_id, {LAGS} FROM l GROUP BY vec_id), u AS ({UNP})
SELECT vec_id, round(least(greatest(regr_slope(ly, lx), 0), 1), 6) AS hurst FROM u GROUP BY vec_id""")
def hurst(t):
    return rnd(E.hurst(t.multi_series, t.by_vec, "x", 2, 10), "hurst")


@query("i5_hurst_venue_50_lags", f"""
WITH l AS (SELECT venue, price, {", ".join(f"lag(price, {k}) OVER w AS lag{k}" for k in range(2, 51))} FROM ticks WINDOW w AS (PARTITION BY venue ORDER BY ts, seq)),
s AS (SELECT venue, count(*) AS n, {", ".join(f"stddev_pop(price - lag{k}) AS t{k}" for k in range(2, 51))} FROM l GROUP BY venue),
u AS ({" UNION ALL ".join(f"SELECT venue, n, ln({k}) AS lx, ln(t{k}) AS ly FROM s" for k in range(2, 51))})
SELECT venue, round(CASE WHEN any_value(n) < 100 THEN 0.5 ELSE least(greatest(regr_slope(ly, lx), 0), 1) END, 6) AS hurst FROM u GROUP BY venue""")
def hurst50(t):
    return rnd(E.hurst(t.ticks, t.by_venue, "price"), "hurst")


@query("i6_rolling_hurst_100", f"""
WITH l AS (SELECT venue, seq, price, row_number() OVER w AS n, {", ".join(f"lag(price, {k}) OVER w AS lag{k}" for k in range(2, 51))} FROM ticks WINDOW w AS (PARTITION BY venue ORDER BY ts, seq)),
s AS (SELECT venue, seq, n, {", ".join(f"stddev_pop(price - lag{k}) OVER (PARTITION BY venue ORDER BY n ROWS {100 - k - 1} PRECEDING) AS t{k}" for k in range(2, 51))} FROM l),
u AS ({" UNION ALL ".join(f"SELECT venue, seq, ln({k}) AS lx, ln(t{k}) AS ly FROM s WHERE least(n, 100) >= {2 * k} AND least(n, 100) // 2 > 2" for k in range(2, 51))}),
h AS (SELECT venue, seq, regr_slope(ly, lx) AS h FROM u GROUP BY 1, 2)
SELECT venue, seq, round(CASE WHEN h IS NULL THEN 0.5 ELSE least(greatest(h, 0), 1) END, 6) AS hurst FROM ticks LEFT JOIN h USING (venue, seq)""")
def rolling_hurst_100(t):
    return rnd(E.rolling_hurst(t.ticks, t.by_venue, "price", 100).select("venue", "seq", "hurst"), "hurst")


ROLL = ", ".join(f"stddev_pop(x - lag{k}) OVER (PARTITION BY vec_id ORDER BY pos ROWS {20 - k - 1} PRECEDING) AS t{k}" for k in range(2, 11))
ROLLU = " UNION ALL ".join(f"SELECT vec_id, pos, ln({k}) AS lx, ln(t{k}) AS ly FROM s WHERE least(pos + 1, 20) >= {2 * k} AND least(pos + 1, 20) // 2 > 2" for k in range(2, 11))


@query("i6_rolling_hurst", f"""
WITH l AS (SELECT vec_id, pos, x, {LAGX} FROM multi_series WINDOW w AS (PARTITION BY vec_id ORDER BY pos)), s AS (SELECT vec_id, pos, {ROLL} FROM l), u AS ({ROLLU}),
h AS (SELECT vec_id, pos, regr_slope(ly, lx) AS h FROM u GROUP BY 1, 2)
SELECT vec_id, pos, round(CASE WHEN h IS NULL THEN 0.5 ELSE least(greatest(h, 0), 1) END, 6) AS hurst FROM multi_series LEFT JOIN h USING (vec_id, pos)""")
def rolling_hurst(t):
    return rnd(E.rolling_hurst(t.multi_series, t.by_vec, "x", 20).select("vec_id", "pos", "hurst"), "hurst")


HILB = """h AS (SELECT a.vec_id, a.pos, any_value(a.x) AS re, sum(CASE WHEN (a.pos - b.pos) % 2 <> 0 THEN b.x * 2.0 / 64 / tan(pi() * (a.pos - b.pos) / 64.0) ELSE 0 END) AS im
  FROM multi_series a JOIN multi_series b ON a.vec_id = b.vec_id GROUP BY 1, 2)"""


@query("i7_phase", f"WITH {HILB} SELECT vec_id, pos, round(cos(atan2(im, re)), 6) AS c, round(sin(atan2(im, re)), 6) AS s FROM h")
def phase(t):
    p = P.phase(t.multi_series, t.by_vec, "x")
    return p.select("vec_id", "pos", F.round(F.cos("phase"), 6).alias("c"), F.round(F.sin("phase"), 6).alias("s"))


@query("i8_kuramoto_order", """
SELECT symbol, round(sqrt(sum(cos(price)) ** 2 + sum(sin(price)) ** 2) / count(*), 6) AS R FROM ticks GROUP BY symbol""")
def order(t):
    return t.ticks.groupBy("symbol").agg(F.round(P.kuramoto("price"), 6).alias("R"))


@query("i9_multi_asset_kuramoto", f"""WITH {HILB} SELECT label, count(*) AS series, round(sqrt(sum(cos(atan2(im, re))) ** 2 + sum(sin(atan2(im, re))) ** 2) / count(*), 6) AS "order"
FROM h JOIN embeddings USING (vec_id) WHERE pos = 63 GROUP BY label""")
def multi(t):
    d = t.multi_series.join(t.raw("embeddings").select("vec_id", "label"), "vec_id")
    return rnd(P.multi_asset_kuramoto(d, t.by_vec, "x", ["label"]), "order")


@query("i10_rolling_kuramoto", f"""WITH {HILB}, p AS (SELECT vec_id, pos, atan2(im, re) AS a FROM h)
SELECT vec_id, pos, round(CASE WHEN count(*) OVER s >= 10 THEN least(sqrt((sum(cos(a)) OVER s) ** 2 + (sum(sin(a)) OVER s) ** 2) / count(*) OVER s, 1) ELSE 0 END, 6) AS kuramoto
FROM p WINDOW s AS (PARTITION BY vec_id ORDER BY pos ROWS 15 PRECEDING)""")
def rolling_kuramoto(t):
    return rnd(P.rolling_kuramoto(t.multi_series, t.by_vec, "x", 16), "kuramoto")


@query("i11_vpin", """
SELECT seq, round(least(coalesce(sum(abs(CASE WHEN seq % 2 = 0 THEN volume ELSE 0 END - CASE WHEN seq % 2 = 1 THEN volume * 0.5 ELSE 0 END)) OVER s / nullif(sum(volume) OVER s, 0), 0), 1), 6) AS vpin
FROM ticks WINDOW s AS (PARTITION BY venue ORDER BY ts, seq ROWS 49 PRECEDING)""")
def vpin(t):
    d = t.ticks.withColumn("b", F.when(F.col("seq") % 2 == 0, F.col("volume")).otherwise(0.0)).withColumn("s", F.when(F.col("seq") % 2 == 1, F.col("volume") * 0.5).otherwise(0.0))
    return rnd(WI.vpin(d, t.by_venue, "volume", "b", "s").select("seq", "vpin"), "vpin")


STEPS = {"15m": 900.0, "1h": 3600.0, "4h": 14400.0}


def hilbert(src: str) -> str:
    """The analytic signal (re, im) of series (k, i from 0, n, x) of any length."""
    m = "(a.i - b.i)"
    return f"""SELECT a.k, a.i, any_value(a.n) AS n, any_value(a.x) AS re, sum(CASE WHEN {m} = 0 THEN 0 WHEN a.n % 2 = 0 THEN CASE WHEN {m} % 2 <> 0 THEN 2 * b.x / a.n / tan(pi() * {m} / a.n) ELSE 0 END
    ELSE b.x * (cos(pi() * {m} / a.n) - CASE WHEN {m} % 2 = 0 THEN 1 ELSE -1 END) / (a.n * sin(pi() * {m} / a.n)) END) AS im FROM {src} a JOIN {src} b ON a.k = b.k GROUP BY 1, 2"""


@query("i12_multiscale_kuramoto", f"""
WITH l AS (SELECT venue, tf, w, epoch_us(ts) // (w * CAST(1000000 AS BIGINT)) AS b, arg_max(price, (ts, seq)) AS price FROM ticks, (VALUES {', '.join(f"('{n}', {int(s)})" for n, s in STEPS.items())}) v(tf, w) GROUP BY 1, 2, 3, 4),
g AS (SELECT venue, tf, unnest(range(min(b), max(b) + 1)) AS b FROM l GROUP BY 1, 2),
f AS (SELECT g.venue || '/' || g.tf AS k, b, last_value(price IGNORE NULLS) OVER (PARTITION BY g.venue, g.tf ORDER BY b) AS p FROM g LEFT JOIN l USING (venue, tf, b)),
n AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY b) - 1 AS i, count(*) OVER (PARTITION BY k) AS n, p FROM f), fit AS (SELECT k, regr_slope(p, i) AS s, regr_intercept(p, i) AS c FROM n GROUP BY k),
x AS MATERIALIZED (SELECT k, i, n, p - s * i - c AS x FROM n JOIN fit USING (k)), h AS ({hilbert("x")}),
r AS (SELECT split_part(k, '/', 1) AS venue, split_part(k, '/', 2) AS tf, least(any_value(n), 256) AS w, sqrt(sum(cos(atan2(im, re))) ** 2 + sum(sin(atan2(im, re))) ** 2) / count(*) AS R FROM h WHERE i >= n - 256 GROUP BY k)
SELECT venue, round(coalesce(avg(R) FILTER (WHERE w >= 64), 0), 6) AS "consensus_R", round(CASE count(*) FILTER (WHERE w >= 64) WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE least(greatest(1 - stddev_pop(R) FILTER (WHERE w >= 64), 0), 1) END, 6) AS coherence,
  arg_max(tf, R) FILTER (WHERE w >= 64) AS dominant, coalesce(string_agg(tf, ',' ORDER BY tf) FILTER (WHERE w < 64), '') AS skipped FROM r GROUP BY venue""")
def multiscale(t):
    return rnd(P.multiscale(t.ticks, t.by_venue, STEPS), "consensus_R", "coherence").withColumn("skipped", F.array_join("skipped", ","))


EDGES = """lv AS (SELECT symbol, ts, seq, price, CAST(round_even((price - p0) / (abs(p0) * 0.05), 0) AS BIGINT) AS l FROM ticks JOIN (SELECT symbol, first(price ORDER BY ts, seq) AS p0 FROM ticks GROUP BY 1) USING (symbol)),
st AS (SELECT *, lag(l) OVER w AS pl, lag(price) OVER w AS pp FROM lv WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)),
edges AS (SELECT symbol, least(l, pl) AS src, greatest(l, pl) AS dst, arg_max(abs(price - pp) + 1, (ts, seq)) AS weight FROM st WHERE pl IS NOT NULL GROUP BY 1, 2, 3)"""


@query("i13_price_graph", f"WITH {EDGES} SELECT symbol, src, dst, round(weight, 6) AS weight FROM edges")
def graph(t):
    return rnd(G.price_edges(t.ticks, t.by_symbol, "price", 0.05), "weight")


@query("i14_edge_curvature")
def curvature(t):
    return rnd(G.edge_curvature(G.price_edges(t.ticks, t.by_symbol, "price", 0.05), ["symbol"]), "weight", "curvature")


@query("i15_mean_ricci")
def mean_ricci(t):
    return rnd(G.mean_curvature(G.price_edges(t.ticks, t.by_symbol, "price", 0.05), ["symbol"]), "mean_ricci")


# 64 points, windows of 20 rows, 10 snapshots: step 4, so windows 2..11 are the newest ten
WG = """r AS (SELECT vec_id, pos, x, win FROM multi_series, (SELECT unnest(range(2, 12)) AS win) WHERE pos >= win * 4 AND pos < win * 4 + 20),
m AS (SELECT *, min(x) OVER g AS lo, max(x) OVER g AS hi FROM r WINDOW g AS (PARTITION BY vec_id, win)),
lv AS (SELECT vec_id, win, pos, CAST(least(floor((x - lo) / ((hi + 1e-6 - lo) / 7)), 7) AS BIGINT) AS l FROM m),
mv AS (SELECT *, lag(l) OVER (PARTITION BY vec_id, win ORDER BY pos) AS p FROM lv),
wg AS (SELECT vec_id, win, least(l, p) AS src, greatest(l, p) AS dst, CAST(count(*) AS DOUBLE) AS c FROM mv WHERE l <> p GROUP BY 1, 2, 3, 4),
ed AS (SELECT vec_id, win, src, dst, c / max(c) OVER (PARTITION BY vec_id, win) AS weight FROM wg), e AS (SELECT * FROM ed WHERE weight > 0.1)"""


@query("i16_temporal_graphs", f"WITH {WG} SELECT vec_id, CAST(win AS BIGINT) AS win, src, dst, round(weight, 6) AS weight FROM e")
def window_graphs(t):
    edges, _ = G.window_graphs(t.multi_series, t.by_vec, "x", window=20, levels=8)
    return edges.select("vec_id", "win", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.round("weight", 6).alias("weight"))


@query("i17_lazy_walk_curvature", f"""WITH {WG}, b AS (SELECT vec_id, win, src AS a, dst AS z FROM e UNION ALL SELECT vec_id, win, dst, src FROM e),
dg AS (SELECT vec_id, win, a, count(*) AS deg FROM b GROUP BY 1, 2, 3),
mu AS (SELECT vec_id, win, a, a AS n, 0.5 AS p FROM dg UNION ALL SELECT b.vec_id, b.win, b.a, b.z, 0.5 / deg FROM b JOIN dg USING (vec_id, win, a)),
d AS (SELECT e.vec_id, e.win, e.src, e.dst, m.n, sum(CASE WHEN m.a = e.src THEN p ELSE -p END) AS p FROM e JOIN mu m ON e.vec_id = m.vec_id AND e.win = m.win AND (m.a = e.src OR m.a = e.dst) GROUP BY 1, 2, 3, 4, 5)
SELECT vec_id, CAST(win AS BIGINT) AS win, src, dst, round(1 - 0.5 * sum(abs(p)), 6) AS curvature FROM d GROUP BY 1, 2, 3, 4""")
def lazy(t):
    edges, _ = G.window_graphs(t.multi_series, t.by_vec, "x", window=20, levels=8)
    c = G.lazy_walk_curvature(edges, ["vec_id", "win"])
    return c.select("vec_id", "win", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.round("curvature", 6).alias("curvature"))


@query("i18_temporal_summary")
def temporal(t):
    return rnd(G.temporal_summary(t.ticks, t.by_venue, "price", "volume", window=100), "temporal_curvature", "transition_score", "stability", "persistence")


IN = "(price / 500) AS R, (volume / 100) AS coh, (price / 400 - 0.6) AS kt, (volume / 110) AS tr, (0.3 - price / 300) AS st"


@query("i19_composite_signal", f"""
WITH i AS (SELECT seq, {IN} FROM ticks), p AS (SELECT *, CASE WHEN R > 0.8 AND st < -0.3 AND kt < -0.2 AND tr < 0.5 THEN 'strong_emergent' WHEN tr > 0.7 THEN 'transition'
  WHEN R > 0.4 AND R <= 0.8 AND tr < 0.5 AND st < 0 THEN 'proto_emergent' WHEN R > 0.4 AND (st > 0 OR kt > 0) THEN 'post_emergent' ELSE 'chaotic' END AS phase FROM i),
c AS (SELECT *, least(greatest(coh * CASE phase WHEN 'strong_emergent' THEN 1 + R WHEN 'chaotic' THEN 0.5 WHEN 'transition' THEN 0.5 + 0.5 * tr ELSE 1 END
  * CASE WHEN least(abs(R - 0.8), abs(R - 0.4)) < 0.1 THEN 0.8 ELSE 1 END, 0), 1) AS conf FROM p)
SELECT seq, phase, round(conf, 6) AS confidence, round(CASE WHEN conf < 0.5 THEN 0 ELSE conf * CASE phase WHEN 'strong_emergent' THEN least(greatest(-kt, 0), 1) WHEN 'proto_emergent' THEN 0.5 * R
  WHEN 'post_emergent' THEN -0.3 ELSE 0 END END, 6) AS entry_signal, round(CASE phase WHEN 'post_emergent' THEN 0.7 WHEN 'transition' THEN least(tr, 1) WHEN 'chaotic' THEN 0.5 WHEN 'strong_emergent' THEN 0.1 ELSE 0.3 END, 6) AS exit_signal,
  round(least(greatest(coh * CASE phase WHEN 'strong_emergent' THEN 1 + 0.5 * conf WHEN 'proto_emergent' THEN 0.7 + 0.3 * conf WHEN 'post_emergent' THEN 0.2 ELSE 0.3 END, 0.1), 2), 6) AS risk_multiplier FROM c""")
def composite(t):
    p, v = F.col("price"), F.col("volume")
    d = t.ticks.select("seq", (p / 500).alias("R"), (v / 100).alias("coh"), (p / 400 - 0.6).alias("kt"), (v / 110).alias("tr"), (0.3 - p / 300).alias("st"))
    out = G.composite_signal(d, R="R", coherence="coh", temporal="kt", transition="tr", static="st")
    names = ["confidence", "entry_signal", "exit_signal", "risk_multiplier"]
    return rnd(out.select("seq", "phase", *names), *names)


@query("i20_phase_flags", """
WITH i AS (SELECT seq, price / 200 AS R, volume / 50 - 1 AS dH, 0.3 - price / 300 AS k FROM ticks)
SELECT seq, CASE WHEN R < 0.4 AND dH > 0 THEN 'proto' WHEN R BETWEEN 0.4 AND 0.7 AND dH <= 0 THEN 'precognitive' WHEN R >= 0.75 AND dH <= -1e-8 AND k <= -1e-8 THEN 'emergent'
  WHEN R <= 0.7 AND dH > 0 THEN 'post-emergent' ELSE 'neutral' END AS phase, round(0.4 * R - 0.3 * dH - 0.3 * k, 6) AS transition FROM i""")
def flags(t):
    R, dH, k = F.col("price") / 200, F.col("volume") / 50 - 1, 0.3 - F.col("price") / 300
    return t.ticks.select("seq", G.phase_flag(R, dH, k).alias("phase"), F.round(G.transition_blend(R, dH, k), 6).alias("transition"))


@query("i21_direction_and_ism", """
SELECT seq, round(0.5 * price + 0.3 * volume + 0.2 * (price - volume), 6) AS direction, round(coalesce(price / nullif(volume - 50, 0), 0), 9) AS ism FROM ticks""")
def direction(t):
    p, v = F.col("price"), F.col("volume")
    return t.ticks.select("seq", F.round(G.direction_index(p, v, p - v), 6).alias("direction"), F.round(G.ism(p, v - 50), 9).alias("ism"))


@query("i22_hierarchical_features")
def hierarchical(t):
    out = P.hierarchical(t.ticks, t.by_venue, {"1h": 3600.0, "4h": 14400.0})
    return rnd(P.with_benchmarks(out, {"entropy": 1.0}), "entropy", "hurst", "kuramoto", "coherence", "entropy_diff")


def amm_input(t):
    return t.ticks.select("symbol", "ts", "seq", (F.col("price") / 5000 - 0.01).alias("x"), (F.col("volume") / 100).alias("R"), (0.2 - F.col("price") / 1000).alias("kappa"))


@query("i24_amm")
def amm(t):
    return AM.amm(amm_input(t), t.by_symbol, "x", "R", "kappa").select("symbol", "seq", *AM.AMM_OUT)


@query("i25_running_quantile", """
SELECT seq, round(quantile_cont(price, 0.8) OVER (PARTITION BY symbol ORDER BY ts, seq), 6) AS q80 FROM ticks""")
def running_quantile(t):
    return rnd(AM.running_quantile(t.ticks, t.by_symbol, "price", 0.8, "q80").select("seq", "q80"), "q80")


@query("i26_amm_combo")
def combo(t):
    return AM.combo(amm_input(t), t.by_symbol, "x", "R", "kappa").select("symbol", "seq", "action", "direction", "size", "q_lo", "q_hi")


RETS = """p AS (SELECT asset, ts, price, volume, spread, price / lag(price) OVER w - 1 AS r, row_number() OVER (PARTITION BY asset ORDER BY ts DESC) AS k FROM aligned WINDOW w AS (PARTITION BY asset ORDER BY ts)),
v AS (SELECT *, CASE WHEN count(r) OVER s = 64 THEN stddev_pop(r) OVER s END AS vol, CASE WHEN count(*) OVER s = 64 THEN avg(volume) OVER s END AS mv, CASE WHEN count(*) OVER s = 64 THEN avg(spread) OVER s END AS ms,
  lag(r) OVER w AS lr FROM p WINDOW s AS (PARTITION BY asset ORDER BY ts ROWS 63 PRECEDING), w AS (PARTITION BY asset ORDER BY ts))"""


def aligned(t):
    times = t.asset_prices.groupBy("ts").agg(F.count(F.lit(1)).alias("n")).filter("n = 3").select("ts")
    return t.asset_prices.join(times, "ts")


def rz(value, hist):
    return f"""(SELECT ({value} - m) / d FROM (SELECT any_value(m) AS m, quantile_cont(abs(x - m), 0.5) AS d FROM {hist}, (SELECT quantile_cont(x, 0.5) AS m FROM {hist})))"""


@query("i27_regime_detector", f"""
WITH aligned AS (SELECT * FROM asset_prices WHERE ts IN (SELECT ts FROM asset_prices GROUP BY ts HAVING count(*) = 3)), {RETS},
hv AS (SELECT ts, avg(vol) AS x FROM v WHERE vol IS NOT NULL GROUP BY ts), hm AS (SELECT ts, avg(mv) AS x FROM v WHERE mv IS NOT NULL GROUP BY ts), hs AS (SELECT ts, avg(ms) AS x FROM v WHERE ms IS NOT NULL GROUP BY ts),
tr AS (SELECT avg(c) AS c, avg(s) AS s, avg(a) AS a FROM (SELECT asset, first(price) FILTER (WHERE k = 1) / first(price) FILTER (WHERE k = 48) - 1 AS c, stddev_pop(r) FILTER (WHERE k <= 47) AS s, corr(r, lr) FILTER (WHERE k <= 46) AS a FROM v GROUP BY asset)),
co AS (SELECT avg(abs(c)) AS c FROM (SELECT corr(a.r, b.r) AS c FROM p a JOIN p b ON a.ts = b.ts AND a.asset < b.asset WHERE a.k <= 64 AND b.k <= 64 GROUP BY a.asset, b.asset)),
o AS (SELECT c / s AS trend_score, a AS trend_autocorr, (SELECT arg_max(x, ts) FROM hv) AS volatility_current, (SELECT quantile_cont(x, 0.3) FROM hv) AS lo, (SELECT quantile_cont(x, 0.7) FROM hv) AS hi,
  ({rz('(SELECT avg(volume) FROM p WHERE k = 1)', 'hm')} - {rz('(SELECT avg(spread) FROM p WHERE k = 1)', 'hs')}) / 2 AS liquidity_score, (SELECT c FROM co) AS mean_abs_corr FROM tr)
SELECT round(trend_score, 6) AS trend_score, round(trend_autocorr, 6) AS trend_autocorr, round(volatility_current, 6) AS volatility_current, round(liquidity_score, 6) AS liquidity_score, round(mean_abs_corr, 6) AS mean_abs_corr,
  CASE WHEN abs(trend_score) >= 1 THEN 'trending' WHEN trend_autocorr <= -0.05 THEN 'mean_reverting' ELSE 'ranging' END AS trend,
  CASE WHEN volatility_current <= lo THEN 'low' WHEN volatility_current >= hi THEN 'high' ELSE 'normal' END AS volatility,
  CASE WHEN liquidity_score >= 0.75 THEN 'high' WHEN liquidity_score <= -0.75 THEN 'low' ELSE 'moderate' END AS liquidity,
  CASE WHEN mean_abs_corr >= 0.6 THEN 'coupled' WHEN mean_abs_corr <= 0.25 THEN 'decoupled' ELSE 'mixed' END AS correlation FROM o""")
def regime(t):
    out = RG.detect(aligned(t), t.by_asset, volume="volume", spread="spread")
    nums = ["trend_score", "trend_autocorr", "volatility_current", "liquidity_score", "mean_abs_corr"]
    return rnd(out.select(*nums, "trend", "volatility", "liquidity", "correlation"), *nums)


@query("i28_market_snapshot")
def market_snapshot(t):
    return rnd(P.snapshot(t.ticks, t.by_venue, "price"), "R", "H", "dH", "kappa", "hurst")


