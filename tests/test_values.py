"""Worked examples and brute-force checks of operators without an SQL twin."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions.symbols import symbol_code, venue_code
from tickloom.operators import execution as X
from tickloom.operators import risk as R
from tickloom.operators.amm import AmmParams, amm_start, amm_step
from tickloom.operators.axis import Axis
from tickloom.operators.graph import curvature_of
from tickloom.operators.performance import _student_tail
from tickloom.operators.phase import analytic_phase


def test_cost_analysis_worked_example(spark):
    fills = spark.createDataFrame([(1, "BrokerA", "X", 0, 50.0, 101.0, 1.0), (1, "BrokerB", "Y", 60, 30.0, 102.0, 0.6), (1, "BrokerA", "X", 120, 20.0, 103.0, 0.4)],
                                  "order_id long, broker string, venue string, ts long, quantity double, price double, fees double")
    parent = spark.createDataFrame([(1, "buy", 100.0, 120.0)], "order_id long, side string, arrival_price double, target_quantity double")
    bench = spark.createDataFrame([(1, 0, 100.5, 500.0), (1, 60, 100.8, 400.0), (1, 120, 101.2, 300.0)], "order_id long, ts long, price double, volume double")
    r = X.order_costs(parent, fills, benchmarks=bench, market=bench.select("order_id", "volume")).first()
    assert r.executed == 100 and r.fees == pytest.approx(2.0)
    assert r.trade_vwap == pytest.approx(101.7) and r.shortfall == pytest.approx(172.0) and r.per_share_shortfall == pytest.approx(1.72)
    assert r.market_vwap == pytest.approx(100.775) and r.participation == pytest.approx(100 / 1200)
    by = {(b.broker, b.venue): b.quantity for b in X.broker_comparison(fills, ["broker", "venue"], F.lit("buy"), F.lit(100.775)).collect()}
    assert by == {("BrokerA", "X"): 70.0, ("BrokerB", "Y"): 30.0}


def test_symbols_and_venues(spark):
    cases = {"btc_usdt": "BTC/USDT", " ethusd ": "ETH/USD", "aapl": "AAPL", "BTC-USD-PERP": "BTC-USD-PERP", "sol/usdc": "SOL/USDC", "btcusdt-perp": "BTC-USDT-PERP"}
    d = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.c for r in d.select("s", symbol_code(F.col("s")).alias("c")).collect()}
    assert got == cases
    assert spark.range(1).select(venue_code(F.lit(" gdax ")).alias("v")).first().v == "COINBASE"


def brute_curvature(edges):
    nodes = sorted({n for a, b, _ in edges for n in (a, b)})
    w = {(a, b): math.inf for a in nodes for b in nodes}
    nb = {n: {} for n in nodes}
    for a, b, x in edges:
        w[a, b] = w[b, a] = min(x, w[a, b])
        nb[a][b] = nb[b][a] = x
    for k, i, j in itertools.product(nodes, nodes, nodes):
        w[i, j] = min(w[i, j], w[i, k] + w[k, j])
    out = []
    for a, b, _ in edges:
        if a == b:
            out.append(0.0)
            continue
        p, q = (np.array(list(nb[n].values())) / sum(nb[n].values()) for n in (a, b))
        m = max(len(p), len(q))
        p, q = (np.sort(np.pad(v, (0, m - len(v)))) for v in (p, q))
        out.append(1 - np.abs(p - q).mean() / w[a, b])
    return out


def test_curvature_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        pairs = {tuple(sorted(rng.integers(0, 9, 2).tolist())) for _ in range(15)}
        edges = [(a, b, 1.0 + float(rng.exponential(3))) for a, b in sorted(pairs)]
        np.testing.assert_allclose(curvature_of(edges), brute_curvature(edges), atol=1e-12)


def test_phase_of_a_cosine_is_linear():
    n = 128
    t = np.arange(n)
    a = analytic_phase(np.cos(2 * np.pi * 5 * t / n))
    np.testing.assert_allclose(np.cos(a), np.cos(2 * np.pi * 5 * t / n), atol=1e-9)


def test_amm_constant_input_has_no_error():
    s, p = amm_start(AmmParams()), AmmParams()
    for _ in range(50):
        o = amm_step(s, 0.01, 0.5, 0.0, None, p)
    # without error only the sinking threshold feeds the pulse
    pulse, theta = 0.0, 0.0
    for _ in range(50):
        pulse = 0.92 * pulse + 0.08 * max(0.0, -theta)
        theta += 0.001 * (pulse - 0.04)
    assert abs(o["pe"]) < 1e-6 and o["pulse"] == pytest.approx(pulse, rel=1e-3) and o["entropy"] >= 0


def test_student_tail_known_values():
    assert _student_tail(0.0, 5) == pytest.approx(0.5)
    assert _student_tail(2.015048, 5) == pytest.approx(0.05, abs=1e-6)
    assert _student_tail(1.812461, 10) == pytest.approx(0.05, abs=1e-6)


def test_psi_of_a_sample_with_itself_is_zero(spark):
    d = spark.range(500).select(F.lit("f").alias("k"), (F.col("id") % 97).cast("double").alias("x"))
    assert R.psi(d, d, ["k"], "x").first().psi == pytest.approx(0.0, abs=1e-12)


def test_ks_of_a_sample_with_itself(spark):
    d = spark.range(300).select(F.lit("f").alias("k"), F.col("id").cast("double").alias("x"))
    r = R.ks(d, d, ["k"], "x").first()
    assert r.ks == pytest.approx(0.0) and r.p == pytest.approx(1.0)


def test_positions_flip_resets_the_entry():
    s = (0.0, 0.0, 0.0)
    for q, p in ((10, 100.0), (10, 110.0), (-30, 120.0)):
        s = X.position_step(s, q, p)
    assert s == (-10.0, 120.0, 300.0)


def test_order_states_flag_illegal_and_repeated(spark):
    rows = [("o", 1, "a", "submit"), ("o", 2, "b", "ack"), ("o", 3, "b", "ack"), ("o", 4, "c", "fill_final"), ("o", 5, "d", "cancel")]
    d = spark.createDataFrame(rows, "order_id string, n long, correlation_id string, event string")
    got = [(r.n, r.to_status, r.legal) for r in X.order_states(d, Axis(("order_id",), "n", (), numeric=True)).orderBy("n").collect()]
    assert got == [(1, "pending", True), (2, "open", True), (4, "filled", True), (5, "filled", False)]
