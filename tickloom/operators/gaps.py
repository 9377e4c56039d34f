"""Missing stretches of a time grid and the plan to fill them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.exprs import micros
from tickloom.operators.axis import Axis, windowed


def gaps(data: DataFrame, bounds: DataFrame, axis: Axis, step: float, *, start: str = "start", end: str = "end") -> DataFrame:
    """Maximal missing runs ``[gap_start, gap_end)`` of the grid ``start, start+step, ... <= end`` of each series.

    Gaps are the long steps between neighbouring present points, so the grid itself is never built.
    ``bounds`` has one row per series.
    """
    keys, width = list(axis.keys), int(round(step * 1e6))
    s, e = micros(start), micros(end)
    b = bounds.select(*keys, s.alias("__s"), (e - F.pmod(e - s, F.lit(width))).alias("__e"))
    on_grid = data.select(*keys, micros(axis.ts).alias("__t")).join(b, keys).filter(
        F.col("__t").between(F.col("__s"), F.col("__e")) & (F.pmod(F.col("__t") - F.col("__s"), F.lit(width)) == 0))
    present = on_grid.select(*keys, "__t").distinct()
    before = b.select(*keys, (F.col("__s") - width).alias("__t"))
    after = b.select(*keys, (F.col("__e") + width).alias("__t"))
    points = present.unionByName(before).unionByName(after)
    along = Axis(axis.keys, "__t", (), axis.grain * 1e6, axis.block_rows, numeric=True)
    steps = windowed(points, along, lambda d, w: d.withColumn("__p", F.lag("__t").over(w)), back=1)
    holes = steps.filter(F.col("__t") - F.col("__p") > width)
    return holes.select(*keys, F.timestamp_micros(F.col("__p") + width).alias("gap_start"), F.timestamp_micros("__t").alias("gap_end"),
                        ((F.col("__t") - F.col("__p")) / width - 1).cast("long").alias("missing"))


def backfill_plan(data: DataFrame, bounds: DataFrame, axis: Axis, step: float) -> DataFrame:
    """Gaps per series with the covered interval; an uncovered series is one full gap."""
    found = gaps(data, bounds, axis, step)
    cover = data.groupBy(*axis.keys).agg(F.min(axis.ts).alias("covered_from"), F.max(axis.ts).alias("covered_to"))
    return found.join(cover, list(axis.keys), "left")


def segments(found: DataFrame, keys: Sequence[str], step: float, size: int) -> DataFrame:
    """Gaps cut into pieces of at most ``size`` grid points, newest first."""
    width = int(round(step * 1e6)) * size
    n = F.ceil((micros("gap_end") - micros("gap_start")) / width)
    cut = found.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))))
    begin = micros("gap_start") + F.col("piece") * width
    return cut.select(*keys, "gap_start", "gap_end", F.timestamp_micros(begin).alias("seg_start"),
                      F.timestamp_micros(F.least(begin + width, micros("gap_end"))).alias("seg_end")).orderBy(
        F.col("seg_end").desc(), *keys)


def payload_check(payload: DataFrame, expected: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Missing, unexpected and repeated times of a loaded segment per series."""
    on = [*keys, ts]
    got = payload.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    both = expected.select(*on).distinct().withColumn("__e", F.lit(True)).join(got, on, "full_outer")
    return both.groupBy(*keys).agg(
        F.count_if(F.col("__n").isNull()).alias("missing"), F.count_if(F.col("__e").isNull()).alias("unexpected"),
        F.count_if(F.col("__n") > 1).alias("repeated"))


def merge_layers(layers: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of layers on key; the later layer wins."""
    tagged = None
    for i, layer in enumerate(layers):
        part = layer.withColumn("__layer", F.lit(i))
        tagged = part if tagged is None else tagged.unionByName(part)
    rest = [c for c in layers[0].columns if c not in keys]
    return tagged.groupBy(*keys).agg(F.max_by(F.struct(*rest, "__layer"), F.col("__layer")).alias("__r")).select(
        *keys, *[F.col("__r")[c].alias(c) for c in rest], F.col("__r")["__layer"].cast("long").alias("layer"))


def synchronise(cache: DataFrame, historical: DataFrame, live: DataFrame, source: DataFrame, bounds: DataFrame, axis: Axis, step: float) -> DataFrame:
    """Merge three layers, fetch what is missing from ``source`` by gap range, and merge again."""
    from tickloom.operators.joins import in_intervals

    on = [*axis.keys, axis.ts]
    merged = merge_layers([cache, historical, live], on)
    holes = gaps(merged, bounds, axis, step).select(*axis.keys, "gap_start", "gap_end")
    fetched = in_intervals(source, holes, ts=axis.ts, start="gap_start", end="gap_end", keys=list(axis.keys)).select(*cache.columns)
    return merge_layers([merged.select(*cache.columns), fetched], on).withColumnRenamed("layer", "fetched")
