"""Market regime labels for a universe of assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.exprs import ladder
from tickloom.operators.aggregates import mean_abs_correlation, newest, pairwise_correlation
from tickloom.operators.axis import Axis, trailing, windowed
from tickloom.operators.quantiles import median_mad, quantiles
from tickloom.operators.windows import pct_change


def _spread(name: str) -> Column:
    """A deviation from the median; NULL where it is 0 or only the rounding error of means of equal values."""
    return F.when(F.col(name) > 1e-12 * F.abs("median"), F.col(name))


def _robust(value: DataFrame, history: DataFrame, column: str, out: str) -> DataFrame:
    m = median_mad(history, [], column)
    unit = F.coalesce(_spread("mad"), _spread("mean_dev"), F.lit(1e-8))
    return value.crossJoin(m).select(((F.col("current") - F.col("median")) / unit).alias(out))


def detect(df: DataFrame, axis: Axis, *, price: str = "price", volume: str | None = None, spread: str | None = None, trend_window: int = 48,
           volatility_window: int = 64, liquidity_window: int = 64, correlation_window: int = 64, trending: float = 1.0,
           reverting: float = -0.05, liquid: float = 0.75, illiquid: float = -0.75, coupled: float = 0.6, decoupled: float = 0.25) -> DataFrame:
    """One row: trend, volatility, liquidity and correlation labels with scores and strategy adjustments.

    Rows must be aligned over assets (same times). Assets are few; each asset's history runs on blocks.
    """
    keys = list(axis.keys)
    asset = keys[0]

    def build(d, w):
        d = d.withColumn("__r", pct_change(price, w))
        s, q = trailing(w, volatility_window), trailing(w, liquidity_window)
        cols = {"__vol": F.when(F.count("__r").over(s) == volatility_window, F.stddev_pop("__r").over(s)),
                "__lr": F.lag("__r").over(w)}
        for name, c in (("__v", volume), ("__s", spread)):
            if c:
                cols[name] = F.when(F.count(c).over(q) == liquidity_window, F.avg(c).over(q))
        return d.withColumns(cols)

    d = windowed(df, axis, build, back=max(volatility_window, liquidity_window) + 1)
    # trend
    tail = newest(df.select(*keys, *axis.order, price), keys, axis.order, trend_window)
    rank = F.col("age_rank")
    move = tail.groupBy(*keys).agg((F.min_by(price, rank) / F.max_by(price, rank) - 1.0).alias("cum"))
    rtail = newest(d.filter(F.col("__r").isNotNull()).select(*keys, *axis.order, "__r", "__lr"), keys, axis.order, max(trend_window - 1, 1))
    inside = F.max("age_rank").over(W.partitionBy(*keys))
    rtail = rtail.withColumn("__lr", F.when(F.col("age_rank") < inside, F.col("__lr")))
    per = rtail.groupBy(*keys).agg(F.nullif(F.stddev_pop("__r"), F.lit(0.0)).alias("sd"), F.when(F.count("__r") > 3, F.corr(
        F.when(F.col("__lr").isNotNull(), F.col("__r")), F.col("__lr"))).alias("ac"))
    trend = move.join(per, keys).agg(F.avg("cum").alias("trend_cumulative_return"), F.greatest(F.coalesce(F.avg("sd"), F.lit(1e-8)), F.lit(1e-8)).alias("trend_volatility"),
                                     F.coalesce(F.avg("ac"), F.lit(0.0)).alias("trend_autocorr"))
    trend = trend.withColumn("trend_score", F.col("trend_cumulative_return") / F.col("trend_volatility"))
    # volatility: mean over assets per time
    vol = d.filter(F.col("__vol").isNotNull()).groupBy(axis.ts).agg(F.avg("__vol").alias("x"))
    now = vol.agg(F.max_by("x", axis.ts).alias("current"))
    cuts = quantiles(vol, [], "x", {"low": 0.3, "high": 0.7}).drop("n")
    m = median_mad(vol, [], "x")
    volatility = now.crossJoin(cuts).crossJoin(m).select(
        F.col("current").alias("volatility_current"), F.col("low").alias("volatility_low"), F.col("high").alias("volatility_high"),
        ((F.col("current") - F.col("median")) / F.coalesce(_spread("mad"), F.lit(1e-8))).alias("volatility_score"))
    # liquidity
    parts = []
    for name, c, sign in (("__v", volume, 1.0), ("__s", spread, -1.0)):
        if c:
            hist = d.filter(F.col(name).isNotNull()).groupBy(axis.ts).agg(F.avg(name).alias("x"))
            latest = df.groupBy(axis.ts).agg(F.avg(c).alias("y")).agg(F.max_by("y", axis.ts).alias("current"))
            parts.append(_robust(latest, hist, "x", "z").select((F.col("z") * sign).alias("z")))
    if not parts:
        sd = newest(d.filter(F.col("__r").isNotNull()).select(*keys, *axis.order, "__r"), keys, axis.order, liquidity_window).groupBy(*keys).agg(
            F.stddev_pop("__r").alias("x")).agg(F.avg("x").alias("current"))
        parts.append(_robust(sd, vol, "x", "z").select((-F.col("z")).alias("z")))
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    liquidity = scores.agg(F.avg("z").alias("liquidity_score"))
    # correlation over the last rows of the shared index
    ctail = newest(d.filter(F.col("__r").isNotNull()).select(*keys, *axis.order, "__r"), keys, axis.order, correlation_window)
    corr = mean_abs_correlation(pairwise_correlation(ctail, on=[axis.ts], item=asset, value="__r")).select("mean_abs_corr", "pairs")
    out = trend.crossJoin(volatility).crossJoin(liquidity).crossJoin(corr)
    return out.withColumns(labels(trending=trending, reverting=reverting, liquid=liquid, illiquid=illiquid, coupled=coupled, decoupled=decoupled)).withColumns(adjustments())


def labels(*, trending: float, reverting: float, liquid: float, illiquid: float, coupled: float, decoupled: float) -> dict[str, Column]:
    c = F.col
    return {
        "trend": ladder([(F.abs("trend_score") >= trending, "trending"), (c("trend_autocorr") <= reverting, "mean_reverting")], "ranging"),
        "volatility": ladder([(c("volatility_current") <= c("volatility_low"), "low"), (c("volatility_current") >= c("volatility_high"), "high")], "normal"),
        "liquidity": ladder([(c("liquidity_score") >= liquid, "high"), (c("liquidity_score") <= illiquid, "low")], "moderate"),
        "correlation": F.when(c("pairs") == 0, "mixed").otherwise(ladder([(c("mean_abs_corr") >= coupled, "coupled"), (c("mean_abs_corr") <= decoupled, "decoupled")], "mixed"))}


def adjustments() -> dict[str, Column]:
    """Factors per label, multiplied."""
    # fixed values: the factors of the labels
    pick = lambda name, table: ladder([(F.col(name) == k, v) for k, v in table.items()], 1.0)
    scale = (pick("trend", {"trending": 1.15, "mean_reverting": 0.9}) * pick("volatility", {"high": 0.6, "low": 1.1})
             * pick("liquidity", {"low": 0.7, "high": 1.05}))
    risk = pick("volatility", {"high": 0.7, "low": 1.05}) * pick("liquidity", {"low": 0.8}) * pick("correlation", {"coupled": 0.85})
    style = ladder([(F.col("liquidity") == "low", "passive"), (F.col("liquidity") == "high", "aggressive")], "normal")
    return {"position_scale": scale, "risk_multiplier": risk, "execution_style": style}
