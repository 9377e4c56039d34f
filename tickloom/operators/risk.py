"""Attribution, tail risk, drift, budgets and text sentiment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.exprs import ladder, ratio
from tickloom.operators.aggregates import breakdown
from tickloom.operators.axis import Axis, running, trailing, windowed
from tickloom.operators.quantiles import quantiles


def factor_attribution(exposures: DataFrame, returns: DataFrame, on: Sequence[str], name: str = "name") -> DataFrame:
    d = exposures.join(returns, [*on, name]).withColumn("pnl", F.col("exposure") * F.col("ret"))
    return breakdown(d, name, "pnl")


def exposure_shares(df: DataFrame, name: str, value: str) -> DataFrame:
    per = df.groupBy(name).agg(F.avg(F.abs(value)).alias("mean_abs"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("mean_abs").alias("__t")))).withColumn("share", ratio(F.col("mean_abs"), F.col("__t"), 0.0)).drop("__t")


def concentration_alerts(shares: DataFrame, limit: float, share: str = "share") -> DataFrame:
    s = F.abs(share)
    return shares.filter(s > limit).withColumn("severity", ladder([(s >= limit * 1.5, "critical"), (s >= limit * 1.1, "warning")], "info"))


def hedge_effectiveness(df: DataFrame, keys: Sequence[str], portfolio: str, hedge: str) -> DataFrame:
    a = df.groupBy(*keys).agg(F.covar_pop(portfolio, hedge).alias("c"), F.var_pop(hedge).alias("vh"), F.var_pop(portfolio).alias("vp"), F.corr(portfolio, hedge).alias("r"))
    beta = ratio(F.col("c"), F.col("vh"), 0.0)
    left = F.col("vp") - F.pow(beta, 2) * F.col("vh")
    return a.select(*keys, beta.alias("beta"), ratio(F.col("vp") - left, F.col("vp"), 0.0).alias("effectiveness"), F.coalesce("r", F.lit(0.0)).alias("correlation"))


def regime_stability(df: DataFrame, regime: str, value: str) -> DataFrame:
    per = df.groupBy(regime).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("vol"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("sharpe", ratio(F.col("mean"), F.col("vol"), 0.0))
    return per.crossJoin(F.broadcast(per.agg(F.stddev_pop("mean").alias("dispersion"))))


def tail_risk(df: DataFrame, axis: Axis, pnl: str, *, horizon: int = 1, confidence: float = 0.95) -> DataFrame:
    """Historical VaR and expected shortfall of overlapping horizon sums."""
    keys = list(axis.keys)

    def build(d, w):
        s = trailing(w, horizon)
        return d.withColumn("__loss", F.when(F.count(pnl).over(s) == horizon, -F.sum(pnl).over(s)))
    d = windowed(df.select(*keys, *axis.order, pnl), axis, build, back=max(horizon - 1, 1)).filter(F.col("__loss").isNotNull())
    q = quantiles(d, keys, "__loss", {"var": confidence})
    return d.join(q, keys).groupBy(*keys).agg(F.max("var").alias("var"), F.avg(F.when(F.col("__loss") >= F.col("var"), F.col("__loss"))).alias("es"), F.max("n").alias("n"))


def shock_scenarios(exposures: DataFrame, shocks: DataFrame) -> DataFrame:
    """Impact per scenario, relative to gross exposure, with the number of shocked assets not held."""
    gross = exposures.agg(F.sum(F.abs("amount")).alias("__g"))
    d = shocks.join(exposures, "asset", "left")
    out = d.groupBy("scenario").agg(F.coalesce(F.sum(F.col("amount") * F.col("shock")), F.lit(0.0)).alias("impact"), F.count_if(F.col("amount").isNull()).alias("missing_assets"))
    return out.crossJoin(F.broadcast(gross)).withColumn("relative", ratio(F.col("impact"), F.col("__g"), 0.0)).drop("__g")


def volatility_scenarios(risk: DataFrame, multipliers: Mapping[str, float], limit: float) -> DataFrame:
    s = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(m)).alias("m")) for n, m in multipliers.items()]))
    d = risk.withColumn("x", s)
    keep = [c for c in risk.columns if c not in ("var", "es")]
    return d.select(*keep, "x.scenario", (F.col("var") * F.col("x.m")).alias("var"), (F.col("es") * F.col("x.m")).alias("es")).withColumn("breach", F.col("var") > limit)


def psi(reference: DataFrame, current: DataFrame, keys: Sequence[str], column: str, bins: int = 10) -> DataFrame:
    """Population stability index over the reference's quantile edges; values outside the edges are not counted."""
    keys = list(keys)
    ps = {f"e{i}": i / bins for i in range(bins + 1)}
    q = quantiles(reference, keys, column, ps).drop("n")
    edges = q.select(*keys, F.array_sort(F.array_distinct(F.array(*ps))).alias("__e"))

    def counts(df, tag):
        d = df.join(edges, keys)
        x, e = F.col(column), F.col("__e")
        last = F.size(e) - 1
        slot = F.least(F.size(F.filter(e, lambda v: v <= x)) - 1, last - 1)
        inside = (x >= e[0]) & (x <= F.element_at(e, -1))
        n = d.groupBy(*keys).agg(F.count(column).alias("__n"))
        return d.filter(inside).groupBy(*keys, slot.alias("bin")).agg(F.count(F.lit(1)).alias("__c")).join(n, keys).select(*keys, "bin", (F.col("__c") / F.col("__n")).alias(tag))
    grid = edges.select(*keys, F.explode(F.sequence(F.lit(0), F.size("__e") - 2)).alias("bin"))
    m = grid.join(counts(reference, "r"), [*keys, "bin"], "left").join(counts(current, "c"), [*keys, "bin"], "left")
    r, c = F.greatest(F.coalesce("r", F.lit(0.0)), F.lit(1e-6)), F.greatest(F.coalesce("c", F.lit(0.0)), F.lit(1e-6))
    return m.groupBy(*keys).agg(F.sum((c - r) * F.log(c / r)).alias("psi"))


def ks(reference: DataFrame, current: DataFrame, keys: Sequence[str], column: str, *, grain: float = 1.0) -> DataFrame:
    """Two-sample statistic and its asymptotic p-value.

    Counts per value run along the value axis on blocks, so no single task orders the whole sample.
    """
    keys = list(keys)
    both = reference.select(*keys, F.col(column).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        current.select(*keys, F.col(column).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = both.groupBy(*keys, "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    tot = per.groupBy(*keys).agg(F.sum("a").alias("__na"), F.sum("b").alias("__nb"))
    run = running(per, Axis(keys, "v", (), grain, numeric=True), {"ca": ("sum", F.col("a")), "cb": ("sum", F.col("b"))}).join(tot, keys)
    d = run.groupBy(*keys).agg(F.max(F.abs(F.col("ca") / F.col("__na") - F.col("cb") / F.col("__nb"))).alias("ks"), F.max("__na").alias("n_ref"), F.max("__nb").alias("n_cur"))
    en = F.sqrt(F.col("n_ref") * F.col("n_cur") / (F.col("n_ref") + F.col("n_cur")))
    lam = (en + 0.12 + 0.11 / en) * F.col("ks")
    tail = F.lit(0.0)
    for k in range(1, 31):
        tail = tail + 2.0 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam)
    return d.withColumn("p", F.when(lam < 0.2, 1.0).otherwise(F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0))))


def severity(value: Column, threshold: Column | float) -> Column:
    r = value / threshold
    return ladder([(r >= 2, "critical"), (r >= 1, "major"), (r >= 0.75, "warning")], "none")


def drift_summary(reference: DataFrame, current: DataFrame, features: Sequence[str], *, psi_limit: float = 0.2, confidence: float = 0.95) -> DataFrame:
    """PSI and KS per feature with severities."""
    tall = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("x")).select("x.*")
    a, b = tall(reference), tall(current)
    d = psi(a, b, ["feature"], "value").join(ks(a, b, ["feature"], "value"), "feature")
    return d.withColumns({"psi_severity": severity(F.col("psi"), psi_limit), "ks_severity": severity(1.0 - F.col("p"), confidence), "drifted": (F.col("psi") >= psi_limit) | (F.col("p") < 1 - confidence)})


def guardrails(metrics: DataFrame, bounds: DataFrame, on: str = "metric") -> DataFrame:
    """Metrics outside (low, high) with the relative distance from the bound (absolute when it is 0)."""
    d = metrics.join(bounds, on)
    bound = F.when(F.col("value") < F.col("low"), F.col("low")).when(F.col("value") > F.col("high"), F.col("high"))
    gap = F.abs(F.col("value") - bound)
    dist = F.when(bound == 0, gap).otherwise(gap / F.abs(F.nullif(bound, F.lit(0.0))))
    return d.withColumn("distance", dist).filter(F.col("distance").isNotNull()).withColumn("severity", ladder([(dist >= 0.5, "critical"), (dist >= 0.2, "major")], "warning"))


def retraining(events: DataFrame, axis: Axis, feature: str, *, span: float = 3600.0, min_events: int = 3, min_features: int = 2) -> DataFrame:
    """Rows (drift events) at which enough events of enough features fell into the trailing window."""
    from tickloom.operators.windows import time_distinct, time_totals

    d = time_totals(time_distinct(events, axis, span, feature, "features"), axis, span, {"events": ("count", F.lit(1))})
    return d.withColumn("retrain", (F.col("events") >= min_events) & (F.col("features") >= min_features))


def cost_advice(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, cost: str, utilisation: str, low: float = 0.3, spike: float = 2.0) -> DataFrame:
    """Mean utilisation and the newest cost against the median of the earlier ones."""
    keys = list(keys)
    last = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("__t"), F.max_by(cost, F.struct(*order)).alias("latest"), F.avg(utilisation).alias("utilisation"))
    med = quantiles(df.join(last, keys).filter(F.struct(*order) < F.col("__t")), keys, cost, {"median": 0.5}).drop("n")
    return last.drop("__t").join(med, keys, "left").withColumn("low_utilisation", F.col("utilisation") < low).withColumn("cost_spike", F.coalesce(F.col("latest") > F.col("median") * spike, F.lit(False)))


def budget_alerts(df: DataFrame, axis: Axis, cost: str, *, period: float, limit: float, thresholds: Sequence[float] = (0.8, 1.0)) -> DataFrame:
    """Rolling spend and the thresholds newly crossed; alerts re-arm below 80 % of the lowest threshold.

    A threshold is newly crossed where no earlier row since the last re-arming reached it, so the places of the last such rows decide and no series is walked in one task.
    Shares are judged at 9 decimals, so that a sum which equals a level counts as having reached it in whatever order its floats were added.
    """
    from tickloom.operators.windows import time_totals

    levels, rearm = sorted(thresholds), round(0.8 * min(thresholds), 9)
    used, place = F.round("used", 9), F.struct(*axis.order)
    d = time_totals(df, axis, period, {"spent": ("sum", F.col(cost))}).withColumn("used", (F.col("spent") / limit).cast("double")).drop("spent")
    marks = {"__armed": ("last", F.when(used < rearm, place))} | {f"__reached{i}": ("last", F.when(used >= t, place)) for i, t in enumerate(levels)}
    d = running(d, axis, marks, exclusive=True)
    new = [F.when((used >= t) & (F.col(f"__reached{i}").isNull() | F.coalesce(F.col(f"__reached{i}") < F.col("__armed"), F.lit(False))), F.lit(float(t))) for i, t in enumerate(levels)]
    return d.withColumn("crossed", F.array_compact(F.array(*new))).drop(*marks)


def slo_alerts(df: DataFrame, axis: Axis, failed: Column, latency: str, *, span: float = 300.0, error_limit: float = 0.05, latency_limit: float = 1.0, cooldown: float = 600.0) -> DataFrame:
    """Error rate and p95 latency of the trailing window, breaches with a cooldown."""
    from tickloom.operators.signals import cooldown_fold
    from tickloom.operators.windows import time_quantile, time_totals

    d = time_totals(df.withColumn("__bad", failed.cast("double")), axis, span, {"error_rate": ("avg", F.col("__bad"))})
    d = time_quantile(d, axis, span, latency, 0.95, "p95")
    d = d.withColumn("breach", (F.col("error_rate") > error_limit) | (F.col("p95") > latency_limit)).drop("__bad")
    return cooldown_fold(d, axis, "breach", cooldown, "alert")


def fingerprint(df: DataFrame, columns: Sequence[str]) -> Column:
    """Digest of the columns in name order; equal content gives equal digests whatever the column order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def sentiment(text: Column, positive: Sequence[str], negative: Sequence[str], boost: Sequence[str] = ()) -> Column:
    """(pos - neg) / (pos + neg) over word hits, stretched by 1.5 where a boost word occurs, within [-1, 1]."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}']+)"), F.lit(1))
    hits = lambda bag: F.size(F.filter(words, lambda w: w.isin(list(bag)))).cast("double")
    p, n = hits(positive), hits(negative)
    score = ratio(p - n, p + n, 0.0)
    if boost:
        score = score * F.when(hits(boost) > 0, 1.5).otherwise(1.0)
    return F.greatest(F.least(score, F.lit(1.0)), F.lit(-1.0))


def text_bins(df: DataFrame, keys: Sequence[str], ts: str, step: float, value: str, source: str) -> DataFrame:
    """Count, mean, deviation and share of distinct sources per bin; empty bins are 0."""
    from tickloom.functions.exprs import time_bin
    from tickloom.operators.bars import time_grid

    keys = list(keys)
    b = df.groupBy(*keys, time_bin(ts, step).alias(ts)).agg(F.count(F.lit(1)).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                                                          (F.count_distinct(source) / F.count(F.lit(1))).alias("diversity"))
    ends = b.groupBy(*keys).agg(F.min(ts).alias("__a"), F.max(ts).alias("__z"))
    return time_grid(ends, keys, "__a", "__z", step, ts).join(b, [*keys, ts], "left").fillna(0.0, ["mean", "std", "diversity"]).fillna(0, ["count"])


def weighted_bins(df: DataFrame, axis: Axis, step: float, score: str, weight: str, source: str) -> DataFrame:
    """Volume-weighted clipped score per bin, its momentum, and the number of sources."""
    from tickloom.functions.exprs import clip, time_bin

    d = df.withColumn("__s", clip(F.col(score), -1.0, 1.0))
    b = d.groupBy(*axis.keys, time_bin(axis.ts, step).alias(axis.ts)).agg(
        F.coalesce(F.sum(F.col("__s") * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0.0)), F.avg("__s")).alias("score"), F.count_distinct(source).alias("sources"))
    return windowed(b, Axis(axis.keys, axis.ts, (), axis.grain), lambda x, w: x.withColumn("momentum", F.col("score") - F.lag("score").over(w)), back=1)


def wide_metrics(df: DataFrame, axis: Axis, step: float, name: str, value: str, names: Sequence[str], *, window: int = 7) -> DataFrame:
    """Metric columns per bin (mean), held forward, with their changes and rolling deviation."""
    from tickloom.functions.exprs import time_bin
    from tickloom.operators.aggregates import pivot_mean
    from tickloom.operators.bars import fill, grid_of

    b = df.withColumn(axis.ts, time_bin(axis.ts, step))
    p = pivot_mean(b, [*axis.keys, axis.ts], name, value, names)
    flat = Axis(axis.keys, axis.ts, (), axis.grain)
    d = fill(grid_of(df, axis, step).join(p, [*axis.keys, axis.ts], "left"), flat, list(names))

    def build(x, w):
        s = trailing(w, window)
        return x.withColumns({k: v for n in names for k, v in ((f"{n}_delta", F.col(n) - F.lag(n).over(w)), (f"{n}_vol", F.stddev_samp(n).over(s)))})
    return windowed(d, flat, build, back=window - 1)
