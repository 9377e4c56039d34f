"""Entropy and scaling exponents of series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.exprs import clip, ratio
from tickloom.operators.aggregates import histogram, newest
from tickloom.operators.axis import BLOCK, HALO, Axis, running, split, unsplit, windowed
from tickloom.operators.bars import interpolate


def entropy(df: DataFrame, keys: Sequence[str], column: str, bins: int = 30, out: str = "entropy") -> DataFrame:
    """Shannon entropy (nats) of the equal-width histogram of each series; 0 for constant or empty ones."""
    keys = list(keys)
    h = histogram(df, keys, column, bins)
    # -sum p ln p = ln n - sum c ln c / n, which needs a single combining pass over the bins
    n = F.sum("count")
    e = h.groupBy(*keys).agg((F.log(n) - F.sum(F.col("count") * F.log("count")) / n).alias(out))
    every = df.select(*keys).distinct()
    return every.join(e, keys, "left").withColumn(out, F.greatest(F.coalesce(out, F.lit(0.0)), F.lit(0.0)))


def delta_entropy(df: DataFrame, axis: Axis, column: str, window: int = 100, bins_range=(10, 50), out: str = "delta_entropy") -> DataFrame:
    """Entropy of the last ``window`` rows minus that of the ``window`` before; 0 when there are too few."""
    keys = list(axis.keys)
    bins = int(min(max(window // 3, bins_range[0]), bins_range[1]))
    tail = newest(df.select(*keys, *axis.order, column), keys, axis.order, 2 * window)
    tail = tail.withColumn("half", F.when(F.col("age_rank") <= window, 1).otherwise(0))
    have = tail.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    e = entropy(tail, [*keys, "half"], column, bins, "h")
    d = e.groupBy(*keys).agg(F.sum(F.when(F.col("half") == 1, F.col("h")).otherwise(-F.col("h"))).alias(out))
    return have.join(d, keys).select(*keys, F.when(F.col("__n") >= 2 * window, F.col(out)).otherwise(0.0).alias(out))


def _slope(pairs: Column) -> Column:
    """Least-squares slope of y on x over an array of (x, y) structs."""
    n = F.size(pairs).cast("double")
    add = lambda f: F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + f(p))
    sx, sy = add(lambda p: p["x"]), add(lambda p: p["y"])
    sxy, sxx = add(lambda p: p["x"] * p["y"]), add(lambda p: p["x"] * p["x"])
    return ratio(n * sxy - sx * sy, n * sxx - sx * sx)


def hurst(df: DataFrame, axis: Axis, column: str, min_lag: int = 2, max_lag: int = 50, out: str = "hurst") -> DataFrame:
    """Slope of ln(deviation of lagged differences) on ln(lag), limited to [0, 1]; 0.5 for short or flat series.

    All lags are read in one pass over the blocks and their deviations combine map side.
    """
    import math

    lags = range(min_lag, max_lag + 1)

    def build(d, w):
        return d.select(*d.columns, *[(F.col(column) - F.lag(column, k).over(w)).alias(f"__d{k}") for k in lags])

    d = windowed(df.select(*axis.keys, *axis.order, column), axis, build, back=max_lag)
    agg = d.groupBy(*axis.keys).agg(F.count(F.lit(1)).alias("__n"), *[F.stddev_pop(f"__d{k}").alias(f"__t{k}") for k in lags])
    pts = F.array(*[F.struct(F.lit(math.log(k)).alias("x"), F.log(F.nullif(F.col(f"__t{k}"), F.lit(0.0))).alias("y")) for k in lags])
    slope = F.when(F.exists(pts, lambda p: p["y"].isNull()), F.lit(None)).otherwise(_slope(pts))
    h = clip(F.coalesce(slope, F.lit(0.5)), 0.0, 1.0)
    return agg.select(*axis.keys, F.when(F.col("__n") >= 2 * max_lag, h).otherwise(0.5).alias(out))


def rolling_hurst(df: DataFrame, axis: Axis, column: str, window: int = 100, min_lag: int = 2, max_lag: int | None = None, out: str = "hurst") -> DataFrame:
    """Hurst exponent of the last ``window`` rows with lags up to half of them; 0.5 until there are enough.

    Missing values are interpolated by row position first. Blocks are streamed in order, a batch of rows with the ``window`` rows before it, and the deviations
    of a lag are taken for thousands of rows at once.
    """
    top = min(window // 2, max_lag or window)
    placed = running(split(df, axis), axis, {"__pos": ("count", F.lit(1))})
    filled = unsplit(interpolate(placed, axis, [column], at=F.col("__pos")))
    filled = filled.withColumn(column, F.coalesce(column, F.lit(0.0)))
    rows = split(filled, axis, back=window + top).withColumn("__x", F.col(column).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, pos = np.zeros(window + top), np.zeros(window + top, np.int64)  # the rows before a batch
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy()
            x, pos = np.concatenate([x, get("__x")]), np.concatenate([pos, get("__pos")])
            parts = [_trailing_hurst(x[i:i + window + top + STRIDE], pos[i + window + top:i + window + top + STRIDE], window, min_lag, top) for i in range(0, batch.num_rows, STRIDE)]
            yield batch.append_column(out, pa.array(np.concatenate(parts) if parts else np.zeros(0)))
            x, pos = x[-window - top:], pos[-window - top:]

    ordered = rows.repartition(*axis.keys, BLOCK).sortWithinPartitions(*axis.keys, BLOCK, *axis.order)
    done = ordered.drop(*([out] if out in rows.columns else [])).mapInArrow(run, T.StructType([*[f for f in rows.schema.fields if f.name != out], T.StructField(out, T.DoubleType())]))
    return unsplit(done.filter(~F.col(HALO))).drop("__pos", "__x")


STRIDE = 2048  # rows whose windows are laid out at a time


def _trailing_hurst(x: np.ndarray, pos: np.ndarray, window: int, min_lag: int, top: int) -> np.ndarray:
    """The exponent of each row of ``pos`` (place in its series, from 1); ``x`` has ``window + top`` values more in front."""
    n, sized = len(pos), np.minimum(pos, window)
    count, sx, sy, sxy, sxx = (np.zeros(n) for _ in range(5))
    flat = np.zeros(n, bool)
    with np.errstate(all="ignore"):
        for k in range(min_lag, top + 1):
            on = sized >= 2 * k
            if not on.any():
                break
            size = max(window - k, 1)
            moved = x[k:] - x[:-k]
            frames = np.lib.stride_tricks.sliding_window_view(moved, size)[-n:]
            shifted = frames - frames[:, -1:]  # equal differences become exact zeros
            held = np.minimum(pos - k, size)  # differences that lie wholly inside the window
            if held.min() < size:
                inside = np.arange(size) >= (size - held)[:, None]
                shifted = np.where(inside, shifted, 0.0)
                shifted = np.where(inside, shifted - (shifted.sum(1) / np.maximum(held, 1))[:, None], 0.0)
            else:
                shifted = shifted - shifted.mean(1)[:, None]
            dev = np.sqrt(np.einsum("ij,ij->i", shifted, shifted) / np.maximum(held, 1))
            lx, ly = np.log(k), np.log(dev)
            flat |= on & (dev == 0)
            for total, term in ((count, 1.0), (sx, lx), (sy, ly), (sxy, lx * ly), (sxx, lx * lx)):
                total += np.where(on, term, 0.0)
        below = count * sxx - sx * sx
        slope = (count * sxy - sx * sy) / below
    slope = np.where(np.isnan(slope), 1.0, np.clip(slope, 0.0, 1.0))  # NaN is above every number in Spark's order
    return np.where((sized // 2 > min_lag) & ~flat & (below != 0), slope, 0.5)
