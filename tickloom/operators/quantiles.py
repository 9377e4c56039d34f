"""Exact interpolated quantiles that do not gather a large group in one place.

``percentile`` keeps a map of every distinct value of a group in one task. Here a mergeable sketch first brackets
each wanted rank, then only the rows inside the bracket (about 0.1 % of a large group) are ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.exprs import join_back

SMALL = 20_000


def quantiles(df: DataFrame, keys: Sequence[str], column: str | Column, ps: Mapping[str, float], *,
              accuracy: int = 10_000, small: int = SMALL) -> DataFrame:
    """One row per key with the linearly interpolated quantile of each name in ``ps`` plus ``n``.

    NULL and NaN values are left out. Groups of at most ``small`` rows are bracketed by their minimum and maximum.
    """
    keys, names = list(keys), list(ps)
    value = F.col(column) if isinstance(column, str) else column
    base = df.select(*keys, value.cast("double").alias("__v")).filter(
        F.col("__v").isNotNull() & ~F.isnan("__v"))
    slack = 4.0 / accuracy
    cuts = [min(1.0, max(0.0, p + d)) for p in ps.values() for d in (-slack, slack)]
    stats = base.groupBy(*keys).agg(
        F.count("__v").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"),
        F.percentile_approx("__v", [float(c) for c in cuts], accuracy).alias("__cuts"))
    marks = F.array(*[F.struct(
        F.lit(i).alias("i"), F.lit(float(p)).alias("p"),
        F.when(F.col("__n") <= small, F.col("__lo")).otherwise(F.col("__cuts")[2 * i]).alias("lo"),
        F.when(F.col("__n") <= small, F.col("__hi")).otherwise(F.col("__cuts")[2 * i + 1]).alias("hi"))
        for i, p in enumerate(ps.values())])
    stats = stats.select(*keys, "__n", marks.alias("__m"))
    joined = join_back(base, stats, keys)
    each = joined.select(*keys, "__n", "__v", F.explode("__m").alias("__mark"))
    at = each.select(*keys, "__n", "__v", *[F.col(f"__mark.{c}").alias(f"__{c}") for c in ("i", "p", "lo", "hi")]).filter(
        F.col("__v") <= F.col("__hi"))
    at = at.withColumn("__slot", F.when(F.col("__v") >= F.col("__lo"), F.col("__v")))
    counted = at.groupBy(*keys, "__n", "__i", "__p", "__slot").agg(F.count(F.lit(1)).alias("__c"))
    by_mark = W.partitionBy(*keys, "__i").orderBy(F.col("__slot").asc_nulls_first())
    upto = counted.withColumn("__end", F.sum("__c").over(by_mark.rowsBetween(W.unboundedPreceding, 0)))
    pos = F.col("__p") * (F.col("__n") - 1)
    low = F.floor(pos)
    upto = upto.withColumn("__begin", F.col("__end") - F.col("__c"))
    known = F.col("__slot").isNotNull()
    has_low = (F.col("__begin") <= low) & (low < F.col("__end")) & known
    high = F.least(low + 1, F.col("__n") - 1)
    has_high = (F.col("__begin") <= high) & (high < F.col("__end")) & known
    solved = upto.groupBy(*keys, "__i").agg(
        F.max(F.when(has_low, F.col("__slot"))).alias("__a"), F.max(F.when(has_high, F.col("__slot"))).alias("__b"),
        F.max(pos - low).alias("__f"), F.max("__n").alias("__n"))
    solved = solved.withColumn("__q", F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__f"))
    return solved.groupBy(*keys).agg(F.max("__n").alias("n"), *[
        F.max(F.when(F.col("__i") == i, F.col("__q"))).alias(name) for i, name in enumerate(names)])


def median_mad(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Median, median absolute deviation and mean absolute deviation per key."""
    keys = list(keys)
    med = quantiles(df, keys, column, {"median": 0.5})
    with_med = join_back(df, med.drop("n"), keys)
    dev = with_med.withColumn("__dev", F.abs(F.col(column) - F.col("median")))
    mad = quantiles(dev, keys, "__dev", {"mad": 0.5})
    mean = dev.groupBy(*keys).agg(F.avg("__dev").alias("mean_dev"))
    return join_back(join_back(med, mad.drop("n"), keys), mean, keys)
