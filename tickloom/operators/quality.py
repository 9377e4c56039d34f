"""Data-quality gates, anomaly quarantine, dead-letter analytics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.exprs import any_of, join_back, micros
from tickloom.operators.axis import Axis, running, windowed
from tickloom.operators.quantiles import median_mad, quantiles


def prior_zscore(df: DataFrame, axis: Axis, column: str, window: int, out: str = "z") -> DataFrame:
    """Score against mean and population deviation of the ``window`` rows before the current one.

    The deviation is Welford's update, written out: the last bit of the squares decides where a score equals a threshold, and Spark's own
    ``stddev_pop`` multiplies them in another way.
    """
    def build(d, w):
        prev = w.rowsBetween(-window, -1)
        d = d.withColumns({"__full": F.count(column).over(prev) == window, "__mean": F.avg(column).over(prev), "__prev": F.collect_list(column).over(prev)})
        zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

        def update(s, x):
            mean = s["mean"] + (x - s["mean"]) / (s["n"] + 1.0)
            return F.struct((s["n"] + 1.0).alias("n"), mean.alias("mean"), (s["m2"] + (x - mean) * (x - s["mean"])).alias("m2"))

        dev = F.sqrt(F.aggregate(F.col("__prev").cast("array<double>"), zero, update, lambda s: s["m2"] / F.lit(float(window))))
        z = (F.col(column) - F.col("__mean")) / F.nullif(dev, F.lit(0.0))
        return d.withColumn(out, F.when(F.col("__full"), z)).drop("__full", "__mean", "__prev")

    return windowed(df, axis, build, back=window)


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row. A combining count, so a hot group of copies stays spread out."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def first_copies(df: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*seq))
    return df.groupBy(*keys).agg(row.alias("__r")).select(*keys, "__r.*").select(*df.columns)


def quarantine(df: DataFrame, axis: Axis, column: str, *, threshold: float, window: int) -> DataFrame:
    """Every row with ``verdict`` duplicate | spike | clean.

    All copies of a duplicated time are listed as ``duplicate``; the first copy is judged again as spike or clean.
    """
    keys = [*axis.keys, axis.ts]
    dups = join_back(df, duplicate_counts(df, keys), keys).drop("copies").withColumn("verdict", F.lit("duplicate")).withColumn(
        "z", F.lit(None).cast("double"))
    unique = first_copies(df, keys, axis.seq) if axis.seq else df.dropDuplicates(keys)
    scored = prior_zscore(unique, axis, column, window)
    judged = scored.withColumn("verdict", F.when(F.abs("z") > threshold, "spike").otherwise("clean"))
    return judged.unionByName(dups)


def range_checks(df: DataFrame, checks: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """Array ``range_violations`` of the columns outside ``{min, max, inclusive_min, inclusive_max}``; NULL passes."""
    marks = []
    for column, c in checks.items():
        x, bad = F.col(column), F.lit(False)
        if c.get("min") is not None:
            bad = bad | (x < c["min"] if c.get("inclusive_min", True) else x <= c["min"])
        if c.get("max") is not None:
            bad = bad | (x > c["max"] if c.get("inclusive_max", True) else x >= c["max"])
        marks.append((x.isNotNull() & bad, column))
    return df.withColumn("range_violations", any_of(marks))


def temporal_contract(df: DataFrame, keys: Sequence[str], ts: str, *, earliest=None, latest=None, expected_start=None,
                      expected_end=None, tolerance: float = 0.0, max_lag: float | None = None, as_of=None) -> DataFrame:
    """Breached time rules per series."""
    span = df.groupBy(*keys).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    at = lambda v: F.lit(v).cast("timestamp")
    off = lambda c, v: F.abs(micros(c) - micros(at(v))) > int(tolerance * 1e6)
    rules = []
    if earliest is not None:
        rules.append((F.col("first_ts") < at(earliest), "earliest"))
    if latest is not None:
        rules.append((F.col("last_ts") > at(latest), "latest"))
    if expected_start is not None:
        rules.append((off("first_ts", expected_start), "expected_start"))
    if expected_end is not None:
        rules.append((off("last_ts", expected_end), "expected_end"))
    if max_lag is not None:
        now = at(as_of) if as_of is not None else F.current_timestamp()
        rules.append((micros(now) - micros("last_ts") > int(max_lag * 1e6), "max_lag"))
    breaches = any_of(rules) if rules else F.array().cast("array<string>")
    return span.withColumn("breaches", breaches)


def quality_gate(df: DataFrame, axis: Axis, column: str, *, threshold: float, window: int, checks: Mapping | None = None,
                 contract: Mapping | None = None, max_fraction: float = 0.1) -> DataFrame:
    """One report row per series: clean, spikes, duplicates, range violations, breaches and the blocked flag."""
    keys = list(axis.keys)
    judged = range_checks(quarantine(df, axis, column, threshold=threshold, window=window), checks or {column: {}})
    out_of_range = F.size("range_violations") > 0
    first = F.col("verdict") != "duplicate"
    rep = judged.groupBy(*keys).agg(
        F.count_if(first).alias("rows"),
        F.count_if((F.col("verdict") == "clean") & ~out_of_range).alias("clean"),
        F.count_if(F.col("verdict") == "spike").alias("spikes"),
        F.count_if(F.col("verdict") == "duplicate").alias("duplicates"),
        F.count_if(first & out_of_range).alias("range_violations"))
    if contract is not None:
        rep = rep.join(temporal_contract(df, keys, axis.ts, **contract).select(*keys, "breaches"), keys)
    else:
        rep = rep.withColumn("breaches", F.array().cast("array<string>"))
    held = (F.col("spikes") + F.col("duplicates")) / F.greatest(F.col("rows"), F.lit(1))
    return rep.withColumn("blocked", (F.size("breaches") > 0) | (F.col("range_violations") > 0) | (held > max_fraction))


def series_schema(df: DataFrame, axis: Axis, values: Sequence[str], *, step: float | None, allow_extra: bool = False,
                  known: Sequence[str] = ()) -> DataFrame:
    """Violations per series: unordered or repeated times, wrong cadence, missing or non-finite values, extra columns."""
    extra = [c for c in df.columns if c not in {*axis.keys, *axis.order, *values, *known}]

    def build(d, w):
        return d.withColumn("__gap", micros(axis.ts) - F.lag(micros(axis.ts)).over(w))

    steps = windowed(df.select(*axis.keys, *axis.order, *values), axis, build, back=1)
    bad_value = F.lit(False)
    for v in values:
        bad_value = bad_value | F.col(v).isNull() | F.isnan(F.col(v).cast("double")) | (F.abs(F.col(v).cast("double")) == float("inf"))
    off = (F.col("__gap") != int(step * 1e6)) & (F.col("__gap") != 0) if step else F.lit(False)
    return steps.groupBy(*axis.keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("__gap") == 0).alias("repeated"),
        F.count_if(off).alias("off_cadence"), F.count_if(bad_value).alias("bad_values")).withColumn(
        "extra_columns", F.lit(0 if allow_extra else len(extra)).cast("long")).withColumn(
        "valid", (F.col("repeated") + F.col("off_cadence") + F.col("bad_values") + F.col("extra_columns")) == 0)


def tick_rules(price: str = "price", volume: str = "volume", bound: float = 1e12) -> Column:
    """Rules a tick breaks: missing, negative, not finite, too large."""
    marks = []
    for c in (price, volume):
        x = F.col(c).cast("double")
        marks += [(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), f"{c}_not_finite"), (x < 0, f"{c}_negative"),
                  ((F.abs(x) > bound) & (F.abs(x) != float("inf")), f"{c}_too_large")]
    return any_of(marks)


def bar_rules() -> Column:
    return any_of([(F.col("low") > F.least("open", "close"), "low_above_body"),
                   (F.col("high") < F.greatest("open", "close"), "high_below_body"),
                   (F.col("high") < F.col("low"), "high_below_low"), (F.col("volume") < 0, "volume_negative")])


def table_sanity(df: DataFrame, *, ts: str | None, numeric: Sequence[str], threshold: float = 10.0, keys: Sequence[str] = ()) -> DataFrame:
    """One row of sanity metrics for a table: NULL ratios, duplicate rows, step statistics, spike counts."""
    cols = [c for c in df.columns if not c.startswith("__")]
    nulls = [F.avg(F.when(F.col(c).isNull() | (F.isnan(c) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.lit(False)), 1.0)
                   .otherwise(0.0)).alias(f"null_{c}") for c in cols]
    base = df.agg(F.count(F.lit(1)).alias("rows"), *nulls)
    base = base.withColumn("null_ratio", sum((F.col(f"null_{c}") for c in cols), F.lit(0.0)) / len(cols))
    distinct = df.select(*cols).distinct().agg(F.count(F.lit(1)).alias("__d"))
    out = base.crossJoin(distinct).withColumn("duplicate_rows", F.col("rows") - F.col("__d")).drop("__d")
    if ts is not None:
        axis = Axis(tuple(keys) or ("__all",), ts)
        src = df.select(*keys, ts) if keys else df.select(F.lit(0).alias("__all"), ts)
        gaps = windowed(src, axis, lambda d, w: d.withColumn("gap", (micros(ts) - F.lag(micros(ts)).over(w)) / 1e6), back=1)
        gaps = gaps.filter(F.col("gap").isNotNull())
        out = out.crossJoin(quantiles(gaps, [], "gap", {"gap_median": 0.5}).drop("n")).crossJoin(
            gaps.agg(F.max("gap").alias("gap_max")))
    for c in numeric:
        stats = median_mad(df.filter(F.col(c).isNotNull()), [], c)
        unit = F.coalesce(F.nullif(F.col("mad"), F.lit(0.0)), F.nullif(F.col("mean_dev"), F.lit(0.0)))
        hits = df.crossJoin(F.broadcast(stats)).agg(
            F.count_if(F.abs(F.col(c) - F.col("median")) / unit > threshold).alias(f"spikes_{c}"))
        out = out.crossJoin(hits)
    return out


def dead_letter_log(letters: DataFrame, *, payload: str, order: Sequence[str], threshold: int = 3) -> DataFrame:
    """Digest, running failure count of the same payload, and the toxic flag; toxic rows change their reason."""
    d = letters.withColumn("digest", F.sha2(F.col(payload), 256))
    axis = Axis(("digest",), order[0], tuple(order[1:]))
    d = running(d, axis, {"failures": ("count", F.lit(1))})
    d = d.withColumn("toxic", F.col("failures") >= threshold)
    return d.withColumn("reason", F.when(F.col("toxic"), "toxic_payload").otherwise(F.col("reason")))


def dead_letter_stats(log: DataFrame, by: str) -> DataFrame:
    return log.groupBy(by).agg(F.count(F.lit(1)).alias("letters"), F.count_if(F.col("toxic")).alias("toxic"))


def replay_candidates(log: DataFrame, *, reasons: Sequence[str] | None = None, include_toxic: bool = False, limit: int | None = None,
                      replayed: DataFrame | None = None, ttl: float | None = None, as_of=None, order: Sequence[str] = ("ts",)) -> DataFrame:
    """Letters to run again: by reason, not toxic, not replayed within the TTL; attempts goes up by one."""
    d = log
    if reasons is not None:
        d = d.filter(F.col("reason").isin(list(reasons)))
    if not include_toxic:
        d = d.filter(~F.col("toxic"))
    if replayed is not None:
        recent = replayed
        if ttl is not None:
            recent = replayed.filter(micros("replayed_at") >= micros(F.lit(as_of).cast("timestamp")) - int(ttl * 1e6))
        d = d.join(recent.select("digest").distinct(), "digest", "left_anti")
    d = d.withColumn("attempts", F.col("attempts") + 1)
    return d.orderBy(*order).limit(limit) if limit is not None else d
