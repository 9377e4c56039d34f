"""Grouped reports. All of them are combining aggregates or start with one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.exprs import finite, join_back, micros, ratio
from tickloom.operators.quantiles import quantiles


def latency_report(df: DataFrame, keys: Sequence[str], value: Column | str, ps: Mapping[str, float] | None = None) -> DataFrame:
    """Count, mean, p50, p95 and maximum; negative values count as 0."""
    x = F.col(value) if isinstance(value, str) else value
    d = df.select(*keys, F.greatest(x, F.lit(0.0)).alias("__x")).filter(F.col("__x").isNotNull())
    q = quantiles(d, keys, "__x", ps or {"p50": 0.5, "p95": 0.95}).drop("n")
    base = d.groupBy(*keys).agg(F.count("__x").alias("count"), F.avg("__x").alias("mean"), F.max("__x").alias("max"))
    return join_back(base, q, list(keys))


def robust_z(df: DataFrame, keys: Sequence[str], column: str, out: str = "robust_z") -> DataFrame:
    """(x - median) / MAD; mean absolute deviation where MAD is 0, then 1e-8."""
    from tickloom.operators.quantiles import median_mad

    stats = median_mad(df, keys, column).drop("n")
    joined = join_back(df, stats, list(keys))
    unit = F.coalesce(F.nullif(F.col("mad"), F.lit(0.0)), F.nullif(F.col("mean_dev"), F.lit(0.0)), F.lit(1e-8))
    return joined.withColumn(out, (F.col(column) - F.col("median")) / unit).drop("median", "mad", "mean_dev")


def linear_fit(y: str, x: str) -> dict[str, Column]:
    """Correlation, population covariance and variance, slope of y on x."""
    return {"corr": F.corr(y, x), "covar": F.covar_pop(y, x), "var": F.var_pop(x), "slope": F.regr_slope(y, x)}


def pairwise_correlation(df: DataFrame, *, on: Sequence[str], item: str, value: str) -> DataFrame:
    """Correlation of each pair of items over the shared index.

    Items must be few (assets, venues): each index value meets every pair of its items.
    """
    a = df.select(*on, F.col(item).alias("a"), F.col(value).alias("x"))
    b = df.select(*on, F.col(item).alias("b"), F.col(value).alias("y"))
    return a.join(b, list(on)).filter("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("corr"), F.count(F.lit(1)).alias("n"))


def mean_abs_correlation(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.coalesce(F.avg(F.abs("corr")), F.lit(0.0)).alias("mean_abs_corr"), F.count("corr").alias("pairs"))


def skewness_of(column: str) -> Column:
    """Population skewness, 0 for a flat series."""
    return F.coalesce(F.when(F.stddev_pop(column) > 0, F.skewness(column)), F.lit(0.0))


def histogram(df: DataFrame, keys: Sequence[str], column: str, bins: Column | int) -> DataFrame:
    """Counts in equal-width bins between the group's finite extremes, the last bin closed.

    Two combining passes; the extremes are joined back on the keys.
    """
    keys = list(keys)
    d = df.withColumn("__x", finite(F.col(column).cast("double"))).filter(F.col("__x").isNotNull())
    n = bins if isinstance(bins, Column) else F.lit(bins)
    ends = d.groupBy(*keys).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    j = join_back(d, ends, keys)
    pos = F.floor(ratio(F.col("__x") - F.col("__lo"), F.col("__hi") - F.col("__lo"), 0.0) * n)
    bin_ = F.least(pos, (n - 1).cast("long"))
    return j.groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def pivot_mean(df: DataFrame, index: Sequence[str], name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Metric rows to columns; the names are given, so no extra pass looks for them."""
    return df.groupBy(*index).pivot(name, list(names)).agg(F.avg(value))


def regression_metrics(truth: str, pred: str, eps: float = 1e-8) -> dict[str, Column]:
    t, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    err = F.abs(t - p)
    sst = F.regr_sxx(t, t)
    return {
        "mae": F.avg(err), "mse": F.avg(err * err), "rmse": F.sqrt(F.avg(err * err)),
        "mape": F.avg(err / F.greatest(F.abs(t), F.lit(eps))),
        "smape": F.avg(err / F.greatest(F.abs(t) + F.abs(p), F.lit(eps))) * 2,
        "r2": F.when(F.count(err) == 0, None).when(F.coalesce(sst, F.lit(0.0)) == 0, F.when(F.max(err) > 0, 0.0).otherwise(1.0)).otherwise(1 - F.sum(err * err) / sst)}


def freshness(df: DataFrame, keys: Sequence[str], ts: str, as_of) -> DataFrame:
    """Latest time and its lag in seconds."""
    return df.groupBy(*keys).agg(F.max(ts).alias("latest_ts")).withColumn(
        "lag_seconds", (micros(F.lit(as_of).cast("timestamp")) - micros("latest_ts")) / 1e6)


def ingest_rate(df: DataFrame, ts: str, *, as_of, window: float = 300.0, span: float = 7200.0) -> DataFrame:
    """Rows per second in each window of the last ``span`` seconds."""
    now = micros(F.lit(as_of).cast("timestamp"))
    width = int(window * 1e6)
    recent = df.filter((micros(ts) > now - int(span * 1e6)) & (micros(ts) <= now))
    return recent.groupBy(F.timestamp_micros(micros(ts) - F.pmod(micros(ts), F.lit(width))).alias("bucket")).agg(
        (F.count(F.lit(1)) / window).alias("per_second"))


def breakdown(df: DataFrame, name: str, value: str) -> DataFrame:
    """Total per component with its share of the total and of the absolute total.

    The grand totals are a second combining aggregate over the few component rows, broadcast back as one row.
    """
    per = df.groupBy(name).agg(F.sum(value).alias("total"))
    all_ = per.agg(F.sum("total").alias("__t"), F.sum(F.abs("total")).alias("__a"))
    return per.crossJoin(F.broadcast(all_)).select(
        name, "total", ratio(F.col("total"), F.col("__t"), 0.0).alias("share"), ratio(F.abs("total"), F.col("__a"), 0.0).alias("abs_share"))


def vwap(quantity: Column, price: Column) -> Column:
    """Volume-weighted price over positive quantities, 0 when there are none."""
    q = F.when(quantity > 0, quantity)
    return F.coalesce(F.sum(q * price) / F.nullif(F.sum(q), F.lit(0.0)), F.lit(0.0))


def microstructure_report(df: DataFrame, keys: Sequence[str], *, bid="bid_volume", ask="ask_volume", returns="returns", signed="signed_volume",
                          infinite: bool = False) -> DataFrame:
    """Samples, queue imbalance, price impact slope and the centred signed-root correlation per key.

    Slope and correlation are over the finite pairs; ``infinite`` keeps all pairs that are not NULL.
    """
    keys = list(keys)
    r, q = [F.col(c) if infinite else finite(F.col(c)) for c in (returns, signed)]
    pair = r.isNotNull() & q.isNotNull()
    d = df.withColumn("__r", F.when(pair, r)).withColumn("__q", F.when(pair, q))
    means = d.groupBy(*keys).agg(F.avg("__q").alias("__m"))
    d = join_back(d, means, keys)
    c = F.col("__q") - F.col("__m")
    d = d.withColumn("__c", F.signum(c) * F.sqrt(F.abs(c)))
    b, a = F.sum(F.greatest(F.col(bid), F.lit(0.0))), F.sum(F.greatest(F.col(ask), F.lit(0.0)))
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), ratio(b - a, b + a, 0.0).alias("avg_queue_imbalance"),
        F.coalesce(F.regr_slope("__r", "__q"), F.lit(0.0)).alias("kyles_lambda"),
        F.coalesce(F.corr("__c", "__r"), F.lit(0.0)).alias("hasbrouck_impulse"))


def imbalance(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 when both are 0."""
    return ratio(a - b, a + b, 0.0)


def cost_report(df: DataFrame, *, ts: str, cost: str, resource: str, usage: str, as_of, window: float) -> DataFrame:
    """Costs in ``[as_of - window, as_of]`` in long form: total, daily average, largest sample, per resource, per usage metric."""
    now = micros(F.lit(as_of).cast("timestamp"))
    d = df.filter(micros(ts).between(now - int(window * 1e6), now))
    item = F.explode(F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("").alias("name")),
        F.struct(F.lit("resource").alias("kind"), F.col(resource).alias("name"))))
    costs = d.select(item.alias("i"), F.col(cost).alias("v")).groupBy("i.kind", "i.name").agg(F.sum("v").alias("value"), F.max("v").alias("__m"))
    more = costs.filter("kind = 'total'").select(F.explode(F.array(
        F.struct(F.lit("daily_average").alias("kind"), (F.col("value") / max(window / 86400.0, 1e-6)).alias("value")),
        F.struct(F.lit("largest_sample").alias("kind"), F.col("__m").alias("value")))).alias("x")).select("x.kind", F.lit("").alias("name"), "x.value")
    uses = d.select(F.explode(usage).alias("name", "v")).groupBy("name").agg(F.sum("v").alias("value")).select(F.lit("usage").alias("kind"), "name", "value")
    return costs.drop("__m").unionByName(more).unionByName(uses)


def portfolio_heat(quantity: Column, price: Column, weight: Column | float = 1.0) -> Column:
    return F.coalesce(F.sum(F.abs(quantity * price * weight)), F.lit(0.0))


def order_rollup(orders: DataFrame, fills: DataFrame, *, order_id: str = "order_id", target: str = "target_quantity") -> DataFrame:
    """Filled quantity, blended price and status per order."""
    f = fills.filter((F.col("quantity") > 0) & (F.col("price") > 0)).groupBy(order_id).agg(
        F.sum("quantity").alias("__q"), (F.sum(F.col("quantity") * F.col("price")) / F.nullif(F.sum("quantity"), F.lit(0.0))).alias("average_price"))
    d = orders.join(f, order_id, "left")
    done = F.col("__q") >= F.col(target) - 1e-9
    return d.withColumn("filled_quantity", F.when(done, F.col(target)).otherwise(F.coalesce("__q", F.lit(0.0)))).withColumn(
        "status", F.when(F.col("__q").isNull(), "open").when(done, "filled").otherwise("partially_filled")).drop("__q")


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The newest ``n`` rows per key with ``age_rank`` 1 = newest (rank limit is pushed below the shuffle)."""
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("age_rank", F.row_number().over(w)).filter(F.col("age_rank") <= n)


def recent_snapshot(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, *, n: int = 50, edge: int = 5) -> DataFrame:
    """Mean, deviation and momentum (mean of the newest ``edge`` minus the oldest ``edge``) of the newest ``n`` rows."""
    d = newest(df, keys, order, n)
    have = d.groupBy(*keys).agg(F.max("age_rank").alias("__k"))
    d = d.join(have, list(keys))
    x = F.col(value)
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"), F.avg(x).alias("mean"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("std"),
        (F.avg(F.when(F.col("age_rank") <= edge, x)) - F.avg(F.when(F.col("age_rank") > F.col("__k") - edge, x))).alias("momentum"))


def decayed_top(df: DataFrame, *, signature: Sequence[str], score: str, ts: str, as_of, decay: float = 1e-6, k: int = 5,
                min_score: float | None = None, digits: int = 4) -> DataFrame:
    """Best record per rounded signature, ranked by score with exponential age decay."""
    sig = [F.round(F.col(c), digits).alias(f"__s{i}") for i, c in enumerate(signature)]
    rest = F.struct(*df.columns)
    best = df.select(*sig, rest.alias("r"), F.col(score).alias("__v"), F.col(ts).alias("__t")).groupBy(
        *[f"__s{i}" for i in range(len(signature))]).agg(F.max_by("r", F.struct("__v", -micros("__t"))).alias("r")).select("r.*")
    age = (micros(F.lit(as_of).cast("timestamp")) - micros(ts)) / 1e6
    out = best.withColumn("decayed", F.col(score) * F.exp(-decay * age))
    if min_score is not None:
        out = out.filter(F.col("decayed") > min_score)
    return out.orderBy(F.col("decayed").desc(), ts).limit(k)
