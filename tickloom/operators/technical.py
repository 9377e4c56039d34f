"""Technical and microstructure feature columns per series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.exprs import finite, quotient, ratio
from tickloom.operators.axis import Axis, ewm, split, trailing, unsplit, windowed
from tickloom.operators.windows import full, pct_change


def rsi(df: DataFrame, axis: Axis, price: str = "price", window: int = 14, out: str = "rsi") -> DataFrame:
    """Relative strength index with Wilder smoothing."""
    def moves(d, w):
        step = F.col(price) - F.lag(price).over(w)
        # greatest() skips NULL, so the row without a step is kept NULL explicitly
        known = step.isNotNull()
        return d.withColumn("__up", F.when(known, F.greatest(step, F.lit(0.0)))).withColumn(
            "__down", F.when(known, F.greatest(-step, F.lit(0.0))))

    d = windowed(df, axis, moves, back=1)
    d = ewm(d, axis, {"__g": ("__up", 1.0 / window), "__l": ("__down", 1.0 / window)}, min_periods={"__g": window, "__l": window})
    return d.withColumn(out, 100.0 - 100.0 / (1.0 + F.col("__g") / (F.col("__l") + 1e-12))).drop("__up", "__down", "__g", "__l")


def macd(df: DataFrame, axis: Axis, price: str = "price", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    span = lambda n: 2.0 / (n + 1.0)
    d = ewm(split(df, axis), axis, {"macd_ema_fast": (price, span(fast)), "macd_ema_slow": (price, span(slow))})
    d = d.withColumn("macd", F.col("macd_ema_fast") - F.col("macd_ema_slow"))
    d = unsplit(ewm(d, axis, {"macd_signal": ("macd", span(signal))}))
    return d.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def signal_features(df: DataFrame, axis: Axis, *, price: str = "price", high: str | None = None, low: str | None = None,
                    volume: str | None = None, bid: str | None = None, ask: str | None = None, signed: str | None = None,
                    windows: Sequence[int] = (5, 20), rsi_window: int = 14, fast: int = 12, slow: int = 26, signal: int = 9,
                    volatility_window: int = 20, micro_window: int = 50, infinite: bool = False) -> DataFrame:
    """All technical columns, and those of volume, queue and signed volume where the inputs exist.

    The imbalance of an empty queue is 0; ``infinite`` leaves what floating point makes of it (NaN).
    """
    span = lambda n: 2.0 / (n + 1.0)
    deepest = max([*windows, volatility_window, micro_window]) + 1

    def build(d, w):
        d = d.withColumn("return_1", pct_change(price, w))
        cols = {}
        for n in windows:
            s = trailing(w, n)
            cols[f"sma_{n}"] = full(F.avg(price).over(s), price, s, n)
            cols[f"volatility_{n}"] = full(F.stddev_samp("return_1").over(s), "return_1", s, n)
        cols["price_range"] = (F.col(high) if high else F.col(price)) - (F.col(low) if low else F.col(price))
        step = F.col(price) - F.lag(price).over(w)
        cols["__up"], cols["__down"] = F.greatest(step, F.lit(0.0)), F.greatest(-step, F.lit(0.0))
        first = F.lag(price).over(w).isNull() | F.col(price).isNull()
        cols["__up"], cols["__down"] = F.when(~first, cols["__up"]), F.when(~first, cols["__down"])
        if volume:
            s = trailing(w, volatility_window)
            cols["log_volume"] = F.log(F.nullif(F.col(volume).cast("double"), F.lit(0.0)))
            cols["volume_z"] = full((F.col(volume) - F.avg(volume).over(s)) / F.nullif(F.stddev_samp(volume).over(s), F.lit(0.0)), volume, s, volatility_window)
        if bid and ask:
            a, b = F.col(bid) - F.col(ask), F.col(bid) + F.col(ask)
            cols["queue_imbalance"] = quotient(a, b) if infinite else ratio(a, b, 0.0)
        d = d.withColumns(cols)
        if signed:
            s = trailing(w, micro_window)
            q, r = finite(F.col(signed).cast("double")), finite(F.col("return_1"))
            ok = q.isNotNull() & r.isNotNull()
            d = d.withColumns({"__y": F.when(ok, r), "__x": F.when(ok, q), "__rx": F.when(ok, F.signum(q) * F.sqrt(F.abs(q)))})
            enough = (F.count(F.lit(1)).over(s) == micro_window) & (F.count("__x").over(s) > 0)
            d = d.withColumns({
                f"kyles_lambda_{micro_window}": F.when(enough, F.coalesce(F.regr_slope("__y", "__x").over(s), F.lit(0.0))),
                f"hasbrouck_{micro_window}": F.when(enough, F.coalesce(F.regr_slope("__y", "__rx").over(s), F.lit(0.0)))}).drop("__x", "__y", "__rx")
        return d

    d = windowed(df, axis, build, back=deepest)
    means = {f"ema_{n}": (price, span(n)) for n in windows}
    need = {f"ema_{n}": n for n in windows}
    means |= {"macd_ema_fast": (price, span(fast)), "macd_ema_slow": (price, span(slow)),
              "__g": ("__up", 1.0 / rsi_window), "__l": ("__down", 1.0 / rsi_window)}
    need |= {"__g": rsi_window, "__l": rsi_window}
    if signed:
        means["signed_volume_ema"] = (signed, span(micro_window))
        need["signed_volume_ema"] = micro_window
    d = ewm(split(d, axis), axis, means, min_periods=need)
    d = d.withColumn("rsi", 100.0 - 100.0 / (1.0 + F.col("__g") / (F.col("__l") + 1e-12)))
    d = d.withColumn("macd", F.col("macd_ema_fast") - F.col("macd_ema_slow")).drop("__up", "__down", "__g", "__l")
    d = unsplit(ewm(d, axis, {"macd_signal": ("macd", span(signal))}))
    return d.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def supervised(features: DataFrame, axis: Axis, columns: Sequence[str], *, price: str = "price", horizon: int = 1, lag: int = 1) -> DataFrame:
    """Lagged clean features with the forward return as ``target``; incomplete rows are dropped."""
    def build(d, w):
        d = d.withColumn("target", quotient(F.lead(price, horizon).over(w), F.col(price)) - 1)
        clean = {c: finite(F.col(c).cast("double")) for c in columns}
        d = d.withColumns(clean)
        return d.withColumns({c: F.lag(c, lag).over(w) for c in columns}) if lag else d

    out = windowed(features, axis, build, back=max(lag, 1), fwd=max(horizon, 1))
    return out.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*columns, "target")]))
