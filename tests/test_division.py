"""A zero price: returns, slopes, scores and logarithms follow floating point, as the SQL has them."""

import math

from pyspark.sql import functions as F

from tickloom.functions.exprs import natural_log, quotient, round_scaled
from tickloom.operators import signals as SG
from tickloom.operators import technical as TE
from tickloom.operators import windows as WI
from tickloom.operators.aggregates import microstructure_report
from tickloom.operators.axis import Axis
from tickloom.operators.folds import evaluate_linear
from tickloom.plans.aggregates import rnd
from tickloom.plans.bars import r as rounded

BY = Axis(("k",), "ts", ("seq",))
PRICES = [4.0, 0.0, 0.0, 2.0, 3.0, 5.0, 4.0, 6.0]
INF = float("inf")


def ticks(spark, prices=PRICES):
    d = spark.createDataFrame([("a", i, p, float(i + 1)) for i, p in enumerate(prices)], "k string, seq long, price double, volume double")
    return d.withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))


def same(got, want):
    return len(got) == len(want) and all(
        a == b or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or abs(a - b) < 1e-12)) for a, b in zip(got, want))


def test_expressions(spark):
    d = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (3.0, 2.0)], "a double, b double")
    rows = d.select(quotient(F.col("a"), F.col("b")).alias("q"), natural_log(F.col("a")).alias("l")).collect()
    assert same([r.q for r in rows], [INF, -INF, math.nan, None, None, 1.5])
    assert same([r.l for r in rows][:4], [0.0, math.nan, -INF, None])
    x = 57.63 / 6.4 - 1  # just below 8.0046875
    d = spark.createDataFrame([(x,), (-x,), (0.5,), (-1.25,), (INF,), (math.nan,), (None,), (1e300,)], "x double")
    assert same([r.y for r in d.select(round_scaled(F.col("x"), 6).alias("y")).collect()], [8.004687, -8.004687, 0.5, -1.25, INF, math.nan, None, 1e300])


def test_changes_keep_infinities(spark):
    rows = WI.changes(ticks(spark), BY, "price", horizon=2).orderBy("seq").collect()
    assert same([r.pct for r in rows][:5], [None, -1.0, math.nan, INF, 0.5])
    assert same([r.forward_return for r in rows][:3], [-1.0, INF, INF])


def test_report_over_all_pairs(spark):
    d = ticks(spark, [4.0, 0.0, 2.0, 3.0])
    d = d.withColumns({"returns": F.when(F.col("seq") == 2, F.lit(INF)).when(F.col("seq") > 0, F.col("price") / 4), "bid_volume": F.col("volume"),
                       "ask_volume": F.col("price"), "signed_volume": F.col("volume")})
    r = microstructure_report(d, ["k"], infinite=True).first()
    assert math.isnan(r.kyles_lambda) and math.isnan(r.hasbrouck_impulse)
    r = microstructure_report(d, ["k"]).first()
    assert math.isfinite(r.kyles_lambda) and math.isfinite(r.hasbrouck_impulse)


def test_supervised_keeps_infinite_targets(spark):
    out = TE.supervised(ticks(spark).withColumn("f", F.col("volume")), BY, ["f"]).orderBy("seq").collect()
    assert [r.seq for r in out] == [1, 2, 3, 4, 5, 6] and same([r.target for r in out][:3], [math.nan, INF, 0.5])


def test_scores_and_backtest(spark):
    d = ticks(spark, [4.0, 0.0, 2.0, 3.0, 5.0]).withColumn("signal", F.lit(1.0))
    assert SG.simple_backtest(d, BY).first().total_return == INF
    position = [r.position for r in SG.pnl_pipeline(d, BY, max_gross=0.8, target_vol=0.5, lookback=3).orderBy("seq").collect()]
    assert position[2] == 0.8  # no finite volatility: the limit holds
    assert SG.mean_reversion(d, BY, lookback=2, threshold=0.2).first().score == 2.0


def test_fold_without_a_fit(spark):
    rows = [("t", 0, "train", INF, 1.0), ("t", 0, "train", 1.0, 2.0), ("t", 0, "train", 2.0, 2.0), ("t", 0, "test", 1.0, 1.0)]
    r = evaluate_linear(spark.createDataFrame(rows, "k string, fold int, role string, x double, y double"), ["k"], ["x"], "y").first()
    assert r.hit_rate == 0.0 and (r.sharpe_ratio, r.total_pnl, r.mae, r.r2) == (None, None, None, None)


def test_registered_rounding_next_to_a_half(spark):
    """A float just below a half goes down, as in the SQL, though its shortest decimal ends on 5."""
    pairs = [(9.63, 6.4, 0.504687), (3.17, 6.4, -0.504687), (12.81, 6.4, 1.001562), (4.0, 8.0, -0.5)]
    d = spark.createDataFrame([(i, a / b - 1) for i, (a, b, _) in enumerate(pairs)], "i int, x double")
    want = [w for _, _, w in pairs]
    assert [r.x for r in rnd(d, "x").orderBy("i").collect()] == want
    assert [r.x for r in d.select("i", *rounded("x")).orderBy("i").collect()] == want


def test_imbalance_of_an_empty_queue(spark):
    d = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 2.0, 6.0), ("a", 2, 3.0, None)], "k string, seq long, price double, volume double").withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    for infinite, want in ((True, [math.nan, 0.5, None]), (False, [0.0, 0.5, 0.0])):
        out = TE.signal_features(d, BY, volume="volume", bid="volume", ask="price", windows=(2,), infinite=infinite)
        assert same([r.queue_imbalance for r in out.orderBy("seq").collect()], want)
