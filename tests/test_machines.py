"""State machines and re-arming alerts: cut into many blocks they equal the walk through the whole series."""

import random

from tickloom.operators.automata import Machine, run_machine
from tickloom.operators.axis import Axis
from tickloom.operators.execution import TRANSITIONS
from tickloom.operators.risk import budget_alerts

EVENTS = ["submit", "ack", "fill_partial", "fill_final", "cancel", "reject", "other", None]


def test_walk_follows_the_table():
    m = Machine({("a", "x"): "b", ("b", "y"): "a"}, "a")
    assert [m.states[s] for s in m.walk([0, 0, 1, 2], 0)] == ["a", "b", "b", "a", "a"]


def test_blocks_equal_the_fold(spark):
    """A machine that never ends, so the start of every block matters, and the order transitions; a hot series of many blocks beside short ones and a NULL key."""
    rng, rows = random.Random(7), []
    turning = {(s, e): "abcd"[("abcd".index(s) + k) % 4] for s in "abcd" for k, e in enumerate(["stay", "next", "over"]) if (s, e) != ("c", "next")}
    for key, n in (("hot", 3000), ("b", 40), ("c", 1), (None, 70)):
        rows += [(key, i, rng.choice(EVENTS), rng.choice(["stay", "next", "over", "?"])) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, event string, turn string").repartition(6)
    for column, table, start in (("event", TRANSITIONS, "pending"), ("turn", turning, "a")):
        want = {}
        for key in {r[0] for r in rows}:
            state = start
            for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
                to = table.get((state, r[2 if column == "event" else 3]))
                want[key, r[1]] = state, to or state, to is not None
                state = to or state
        for size in (100, 1_000_000):
            got = run_machine(df, Axis(("k",), "i", (), grain=10.0, block_rows=size, numeric=True), column, table, start).collect()
            assert {(r.k, r.i): (r.from_status, r.to_status, r.legal) for r in got} == want and len(got) == len(rows)


def test_alerts_rearm_across_blocks(spark):
    rng = random.Random(2)
    rows = [("a", i, f"2024-01-01 00:{i // 60:02}:{i % 60:02}", rng.choice([0.0, 1.0, 4.0, 30.0])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i long, at string, cost double").selectExpr("k", "i", "cast(at as timestamp) as ts", "cost")
    want, seen = {}, set()
    for i, row in enumerate(rows):
        used = sum(r[3] for r in rows[max(0, i - 5):i + 1]) / 40
        seen = set() if used < 0.64 else seen
        new = [t for t in (0.8, 1.0) if used >= t and t not in seen]
        seen |= set(new)
        want[i] = new
    for size in (50, 1_000_000):
        got = budget_alerts(df, Axis(("k",), "ts", ("i",), grain=5.0, block_rows=size), "cost", period=5.0, limit=40.0).collect()
        assert {r.i: r.crossed for r in got} == want


def test_trades_across_blocks(spark):
    """Arbitrage with balances, venues nobody listed and a hot symbol of many blocks equals the walk over sorted rows."""
    from tickloom.operators.arbitrage import Rule, arbitrage, step

    rng, quotes, held = random.Random(5), [], []
    for symbol, n in (("hot", 900), ("b", 30), (None, 20)):
        for i in range(n):
            at = f"2024-01-01 {i // 3600:02}:{i // 60 % 60:02}:{i % 60:02}"
            bid = 100 + rng.gauss(0, 2)
            quotes.append((symbol, at, i, rng.choice("uvwxyz"), bid, bid + rng.random(), float(rng.randint(0, 5)), float(rng.randint(1, 5))))
            if rng.random() < 0.1:
                held.append((symbol, at, i, rng.choice("uvwxyz"), rng.choice([0.0, 0.5, 9.0]), rng.choice([0.0, 60.0, 9000.0])))
    rule = Rule(max_age=40.0, max_skew=30.0, fee=0.001, fees={"u": 0.01}, min_profit=0.1)
    q = spark.createDataFrame(quotes, "symbol string, at string, i long, venue string, bid double, ask double, bid_size double, ask_size double").selectExpr("*", "cast(at as timestamp) as ts", "2 * i + 1 as n")
    h = spark.createDataFrame(held, "symbol string, at string, i long, venue string, base_available double, quote_available double").selectExpr("*", "cast(at as timestamp) as ts", "2 * i as n")
    want = {}
    for symbol in ("hot", "b", None):
        state = {}, {}
        rows = [(2 * r[2] + 1, r[3], r[4:], (None, None)) for r in quotes if r[0] == symbol] + [(2 * r[2], r[3], (None,) * 4, r[4:]) for r in held if r[0] == symbol]
        for n, venue, quote, balance in sorted(rows, key=lambda r: r[0]):
            if trade := step(rule, state, venue, n // 2 * 1_000_000, quote, balance):
                want[symbol, n] = trade
    assert len(want) > 100
    for size in (60, 1_000_000):
        got = arbitrage(q, Axis(("symbol",), "ts", ("n",), grain=5.0, block_rows=size), rule, balances=h).collect()
        assert {(r.symbol, r.n): (r.buy_venue, r.sell_venue, r.buy_price, r.sell_price, r.size, r.notional, r.profit) for r in got} == want and len(got) == len(want)


def test_orders_walk_the_book(spark):
    from tickloom.operators.execution import walk_book

    rng = random.Random(8)
    levels = [(b, side, float(p), float(rng.randint(1, 9))) for b in ("m", "n") for side, ps in (("ask", range(101, 121)), ("bid", range(80, 100))) for p in ps if b == "m" or side == "ask"]
    orders = [(i, rng.choice("mno"), rng.choice(["BUY", "sell"]), float(rng.choice([0, 1, 5, 9, 40, 90, 500])), 100.0) for i in range(200)]
    got = {r.id: r for r in walk_book(spark.createDataFrame(orders, "id long, b string, side string, quantity double, mid double"), spark.createDataFrame(levels, "b string, side string, price double, quantity double"), book=["b"], order=["id"]).collect()}
    assert len(got) == 200
    for i, b, side, quantity, mid in orders:
        buy = side.lower() == "buy"
        left, value, last = quantity, 0.0, mid
        mine = sorted(((p, q) for k, s, p, q in levels if k == b and s == ("ask" if buy else "bid")), reverse=not buy)
        for p, q in mine:
            if left > 0:
                last, value, left = p, value + p * min(q, left), left - min(q, left)
        worse = last * (1.0015 if buy else 0.9985)
        assert abs(got[i].shortfall - left) < 1e-9 and got[i].depth == sum(q for _, q in mine)
        assert got[i].average_price is None if quantity == 0 else abs(got[i].average_price - (value + left * worse) / quantity) < 1e-9
