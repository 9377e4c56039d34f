"""Instantaneous phase and synchrony.

The phase of a row is the angle of the series' analytic signal, whose imaginary part is a circular convolution of the whole series. Series of up to ``BLOCK_POINTS`` rows are transformed
whole, many at a time. A longer one is transformed in blocks: its points are laid out as a matrix, transformed along columns, exchanged, transformed along rows (where it meets the transform of the
kernel), and taken back the same way, so that no task holds more than about ``BLOCK_POINTS`` points.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.exprs import clip, finite, join_back
from tickloom.operators.axis import Axis, row_numbers, running, settle, split, trailing, unsplit, windowed
from tickloom.operators.bars import interpolate, multi_timeframe

BLOCK_POINTS = 1 << 17  # a task of four holds a few times this many points of 16 bytes, whatever the length of the series


def analytic_phase(x: np.ndarray, detrend: bool = False) -> np.ndarray:
    """Angle of the analytic signal of finite series of one length (the last axis)."""
    n = x.shape[-1]
    if x.size == 0:
        return x.astype(float)
    if detrend:
        t = np.arange(n, dtype=float) - (n - 1) / 2
        x = x - x.mean(-1, keepdims=True)
        x = x - (x @ t / max((t * t).sum(), 1.0))[..., None] * t
    gain = np.zeros(n)
    gain[0] = 1.0
    gain[1:(n + 1) // 2] = 2.0
    if n % 2 == 0:
        gain[n // 2] = 1.0
    return np.angle(np.fft.ifft(np.fft.fft(x) * gain))


def hilbert_kernel(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """The kernel of a series of ``n`` points at the places ``at`` of a circle of ``size``: offset m stands at m, and at size - |m| if negative."""
    m = np.where(at < n, at, at - size)
    angle = np.pi * m / n
    with np.errstate(divide="ignore", invalid="ignore"):
        h = (np.cos(angle) * (m % 2) * 2 if n % 2 == 0 else np.cos(angle) - 1 + 2 * (m % 2)) / (n * np.sin(angle))
    return np.where((m == 0) | (np.abs(m) >= n), 0.0, h)


class Layout:
    """A circle of a power of two of at least 2n - 1 places as ``rows`` x ``columns``, place j at (j // columns, j % columns), and how many of each a block takes."""

    def __init__(self, n: int, block: int):
        bits = max(int(2 * n - 2).bit_length(), 2)
        self.n, self.size = n, 1 << bits
        self.rows = 1 << bits // 2
        self.columns = self.size // self.rows
        self.wide, self.tall = (min(max(block // k, 1), most) for k, most in ((self.rows, self.columns), (self.columns, self.rows)))

    def turn(self, k1: np.ndarray, j2: np.ndarray) -> np.ndarray:
        return np.exp(-2j * np.pi * (np.outer(k1, j2) % self.size) / self.size)

    def down(self, x: np.ndarray, first: int) -> list[bytes]:
        """Columns from ``first`` on, transformed along the column and turned; a piece for each block of rows."""
        got = np.fft.fft(x, axis=0) * self.turn(np.arange(self.rows), first + np.arange(x.shape[1]))
        return [got[i:i + self.tall].tobytes() for i in range(0, self.rows, self.tall)]

    def across(self, x: list[bytes], h: list[bytes], first: int) -> list[bytes]:
        """Rows from ``first`` on, from their pieces: transformed along the row, multiplied, and back as far; a piece for each block of columns."""
        whole = lambda parts: np.concatenate([np.frombuffer(p, np.complex128).reshape(self.tall, -1) for p in parts], axis=1)
        got = np.fft.ifft(np.fft.fft(whole(x), axis=1) * np.fft.fft(whole(h), axis=1), axis=1)
        got = got * self.turn(first + np.arange(self.tall), np.arange(self.columns)).conj()
        return [np.ascontiguousarray(got[:, i:i + self.wide]).tobytes() for i in range(0, self.columns, self.wide)]

    def up(self, pieces: list[bytes]) -> np.ndarray:
        """Columns of the convolution."""
        return np.fft.ifft(np.concatenate([np.frombuffer(p, np.complex128).reshape(self.tall, -1) for p in pieces]), axis=0).real


def _in_blocks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], block: int, out: str) -> DataFrame:
    """Phases of ``rows`` (keys, order, ``__i`` from 0, ``__n``, finite ``__x``), by three exchanges of pieces of at most ``block`` points."""
    layout = lambda pdf: Layout(int(pdf["__n"].iloc[0]), block)
    key_fields = [rows.schema[k] for k in keys]
    place = T.StructType([*key_fields, T.StructField("__n", T.LongType()), T.StructField("__r", T.LongType()), T.StructField("__c", T.LongType())])
    bits = rows.withColumn("__bits", F.greatest(F.length(F.bin(2 * F.col("__n") - 2)), F.lit(2)))  # the layout's sizes, as in ``Layout``
    sizes = bits.withColumns({"__height": F.expr("shiftleft(1L, int(floor(__bits / 2)))"), "__width": F.expr("shiftleft(1L, __bits - int(floor(__bits / 2)))")})
    width = F.col("__width")
    laid = sizes.withColumns({"__j1": F.floor(F.col("__i") / width), "__j2": F.col("__i") % width, "__wide": F.least(F.greatest(F.floor(F.lit(block) / F.col("__height")), F.lit(1)), width)})
    laid = laid.withColumn("__c", F.floor(F.col("__j2") / F.col("__wide")))

    def named(pdf: pd.DataFrame, r, c) -> dict:
        return {k: [pdf[k].iloc[0]] * len(r) for k in keys} | {"__n": pdf["__n"].iloc[0], "__r": r, "__c": c}

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        to, c = layout(pdf), int(pdf["__c"].iloc[0])
        first = c * to.wide
        x = np.zeros((to.rows, to.wide))
        x[pdf["__j1"].to_numpy(), pdf["__j2"].to_numpy() - first] = pdf["__x"].to_numpy()
        h = hilbert_kernel(np.arange(to.rows)[:, None] * to.columns + first + np.arange(to.wide), to.n, to.size)
        x, h = to.down(x, first), to.down(h, first)
        return pd.DataFrame(named(pdf, range(len(x)), c) | {"__x": x, "__h": h})

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        to, r, pdf = layout(pdf), int(pdf["__r"].iloc[0]), pdf.sort_values("__c")
        x = to.across(pdf["__x"].tolist(), pdf["__h"].tolist(), r * to.tall)
        return pd.DataFrame(named(pdf, [r] * len(x), range(len(x))) | {"__x": x})

    def up(mine: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        to, first = layout(mine), int(mine["__c"].iloc[0])
        y = to.up(pieces.sort_values("__r")["__x"].tolist())
        im = y[mine["__j1"].to_numpy(), mine["__j2"].to_numpy() - first * to.wide]
        return mine[[*keys, *order]].assign(**{out: np.arctan2(im, mine["__x"].to_numpy())})

    binary = lambda *names: T.StructType([*place.fields, *[T.StructField(n, T.BinaryType()) for n in names]])
    columns = laid.select(*keys, "__n", "__c", "__j1", "__j2", "__x").groupBy(*keys, "__c").applyInPandas(down, binary("__x", "__h"))
    crossed = columns.groupBy(*keys, "__r").applyInPandas(across, binary("__x"))
    schema = T.StructType([rows.schema[c] for c in [*keys, *order]] + [T.StructField(out, T.DoubleType())])
    return laid.groupBy(*keys, "__c").cogroup(crossed.groupBy(*keys, "__c")).applyInPandas(up, schema)


def phase(df: DataFrame, axis: Axis, column: str, *, detrend: bool = False, out: str = "phase", block_points: int = BLOCK_POINTS) -> DataFrame:
    """Phase of every row. Missing and infinite values count as 0 (as the series mean when ``detrend``).

    Only the key, the order and the value travel to Python. Series longer than ``block_points`` are transformed in blocks, with the same result.
    """
    keys, order = list(axis.keys), list(axis.order)
    x = finite(F.col(column).cast("double"))
    slim = settle(df.select(*keys, *order, x.alias("__x")))
    schema = T.StructType([slim.schema[c] for c in [*keys, *order]] + [T.StructField(out, T.DoubleType())])
    long = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.avg("__x").alias("__mean")).where(F.col("__n") > block_points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def phased(table: pa.Table) -> pa.RecordBatch:
            x = table["__x"].to_numpy()
            start = np.flatnonzero(table["__i"].to_numpy() == 1)
            size, got = np.diff(np.append(start, len(x))), np.empty(len(x))
            for n in np.unique(size):
                at = start[size == n][:, None] + np.arange(n)
                block = x[at]
                good = np.isfinite(block)
                mean = np.where(good, block, 0.0).sum(1) / np.maximum(good.sum(1), 1) if detrend else np.zeros(len(block))
                got[at] = analytic_phase(np.where(good, block, mean[:, None]), detrend)
            return table.drop_columns(["__x", "__i"]).append_column(out, pa.array(got)).combine_chunks().to_batches()[0]

        for batch in batches:
            first = np.flatnonzero(batch.column(batch.schema.get_field_index("__i")).to_numpy() == 1)
            if held and len(first) and sum(b.num_rows for b in held) + first[-1] > 0:
                whole = pa.Table.from_batches([*held, batch.slice(0, first[-1])])
                if whole.num_rows:
                    yield phased(whole)
                held = [batch.slice(first[-1])]
            else:
                held.append(batch)
        if held and (table := pa.Table.from_batches(held)).num_rows:
            yield phased(table)

    same = [F.col(k).eqNullSafe(F.col(f"__l_{k}")) for k in keys]
    listed = long.withColumnsRenamed({k: f"__l_{k}" for k in keys}).select(*[f"__l_{k}" for k in keys])
    short = slim.join(listed, same, "left_anti").withColumn("__i", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    whole = short.select(*keys, *order, "__x", "__i").mapInArrow(run, schema)

    hot = join_back(slim, long, keys)
    hot = row_numbers(hot.withColumn("__x", F.coalesce("__x", F.col("__mean") if detrend else F.lit(0.0), F.lit(0.0))), axis, "__i").withColumn("__i", F.col("__i") - 1)
    if detrend:
        line = hot.groupBy(*keys).agg(F.regr_slope("__x", "__i").alias("__slope"), F.avg("__x").alias("__level"))
        hot = join_back(hot, line, keys).withColumn("__x", F.col("__x") - F.col("__level") - F.col("__slope") * (F.col("__i") - (F.col("__n") - 1) / 2))
    return whole.unionByName(_in_blocks(hot.select(*keys, *order, "__i", "__n", "__x"), keys, order, block_points, out))


def kuramoto(angle: str) -> Column:
    """Order parameter of a group of angles; missing angles are left out and values under 1e-8 are 0."""
    a = finite(F.col(angle).cast("double"))
    r = F.sqrt(F.pow(F.sum(F.cos(a)), 2) + F.pow(F.sum(F.sin(a)), 2)) / F.nullif(F.count(a), F.lit(0))
    r = F.coalesce(r, F.lit(0.0))
    return F.when(r < 1e-8, 0.0).otherwise(F.least(r, F.lit(1.0)))


def multi_asset_kuramoto(df: DataFrame, axis: Axis, column: str, group: Sequence[str]) -> DataFrame:
    """Synchrony of the last phases of the series of each group; all series of a group must be equally long."""
    p = phase(df, axis, column)
    last = p.groupBy(*axis.keys).agg(F.max_by("phase", F.struct(*axis.order)).alias("phase"), F.count(F.lit(1)).alias("__n"))
    rest = [g for g in group if g not in axis.keys]
    if rest:
        last = last.join(df.select(*axis.keys, *rest).distinct(), list(axis.keys))
    agg = last.groupBy(*group).agg(kuramoto("phase").alias("order"), F.count(F.lit(1)).alias("series"), F.min("__n").alias("__a"), F.max("__n").alias("__b"))
    return agg.select(*group, "series", F.when(F.col("__a") == F.col("__b"), F.col("order")).alias("order"))


def rolling_kuramoto(df: DataFrame, axis: Axis, column: str, window: int = 200, coupling: float = 1.0, out: str = "kuramoto") -> DataFrame:
    """Rolling order parameter of a series' phases; 0 until ``min(window, 10)`` rows."""
    placed = row_numbers(split(df.select(*axis.keys, *axis.order, finite(F.col(column).cast("double")).alias(column)), axis), axis, "__pos")
    filled = unsplit(interpolate(placed, axis, [column], at=F.col("__pos")))
    p = phase(filled, axis, column)

    def build(d, w):
        s = trailing(w, window)
        n = F.count(F.lit(1)).over(s)
        r = F.sqrt(F.pow(F.sum(F.cos("phase")).over(s), 2) + F.pow(F.sum(F.sin("phase")).over(s), 2)) / n
        return d.withColumn(out, F.when(n >= min(window, 10), clip(coupling * r, 0.0, 1.0)).otherwise(0.0))

    return windowed(p, axis, build, back=max(window - 1, 1)).drop("phase")


def multiscale(df: DataFrame, axis: Axis, steps: Mapping[str, float], price: str = "price", *, window: int = 256, min_samples: int = 64) -> DataFrame:
    """Order parameter per timeframe (tail of ``window`` bars of detrended phases) folded into a consensus per key."""
    keys = list(axis.keys)
    bars = multi_timeframe(df, axis, steps, price)
    tall = Axis([*keys, "timeframe"], "bucket", (), axis.grain, axis.block_rows)
    p = phase(bars, tall, price, detrend=True)
    numbered = running(p, tall, {"__back": ("count", F.lit(1), True)})
    per = numbered.groupBy(*keys, "timeframe").agg(
        kuramoto_of(F.when(F.col("__back") <= window, F.col("phase"))).alias("R"), F.least(F.count(F.lit(1)), F.lit(window)).alias("window"))
    used = F.col("window") >= min_samples
    order = {n: i for i, n in enumerate(steps)}
    rank = F.create_map(*[x for n, i in order.items() for x in (F.lit(n), F.lit(-i))])
    n = F.count_if(used)
    agg = per.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(used, F.col("R"))), F.lit(0.0)).alias("consensus_R"),
        F.when(n == 0, 0.0).when(n == 1, 1.0).otherwise(clip(1.0 - F.stddev_pop(F.when(used, F.col("R"))), 0.0, 1.0)).alias("coherence"),
        F.max_by("timeframe", F.when(used, F.struct("R", rank[F.col("timeframe")]))).alias("dominant"),
        F.array_sort(F.collect_list(F.when(~used, F.col("timeframe")))).alias("skipped"))
    return agg


def kuramoto_of(angle: Column) -> Column:
    r = F.sqrt(F.pow(F.sum(F.cos(angle)), 2) + F.pow(F.sum(F.sin(angle)), 2)) / F.nullif(F.count(angle), F.lit(0))
    return F.coalesce(r, F.lit(0.0))


def hierarchical(df: DataFrame, axis: Axis, steps: Mapping[str, float], *, price: str = "price", book: DataFrame | None = None,
                 bins: int = 30) -> DataFrame:
    """Per timeframe entropy, Hurst and synchrony of closes aligned to the first timeframe, plus cross-timeframe coherence.

    ``book`` may give (keys, timeframe, bucket, imbalance, microprice).
    """
    from tickloom.operators.entropy import entropy, hurst
    from tickloom.operators.joins import asof

    keys, names = list(axis.keys), list(steps)
    bars = multi_timeframe(df, axis, steps, price)
    ref = bars.filter(F.col("timeframe") == names[0]).select(*keys, "bucket")
    frame = ref.withColumn("timeframe", F.explode(F.array(*[F.lit(n) for n in names])))
    aligned = asof(frame, bars.withColumnRenamed(price, "close"), keys=[*keys, "timeframe"], ts="bucket", values=["close"], grain=axis.grain).drop("matched_ts")
    tall = Axis([*keys, "timeframe"], "bucket", (), axis.grain, axis.block_rows)
    aligned = windowed(aligned, tall, lambda d, w: d.withColumn("ret", F.coalesce(F.col("close") - F.lag("close").over(w), F.lit(0.0))), back=1)
    aligned = settle(aligned)
    p = phase(aligned, tall, "ret")
    per = entropy(aligned, tall.keys, "ret", bins).join(hurst(aligned, tall, "close"), [*keys, "timeframe"]).join(
        p.groupBy(*keys, "timeframe").agg(kuramoto("phase").alias("kuramoto")), [*keys, "timeframe"])
    across = p.groupBy(*keys, "bucket").agg(kuramoto_of(F.col("phase")).alias("c")).groupBy(*keys).agg(F.avg("c").alias("coherence"))
    per = per.join(across, keys)
    if book is not None:
        b = aligned.join(book, [*keys, "timeframe", "bucket"]).groupBy(*keys, "timeframe").agg(
            F.avg("imbalance").alias("book_imbalance"), F.avg(F.col("microprice") - F.col("close")).alias("microprice_basis"))
        per = per.join(b, [*keys, "timeframe"], "left")
    return per


def with_benchmarks(features: DataFrame, expected: Mapping[str, float]) -> DataFrame:
    """Difference of each named feature from its expected value."""
    return features.withColumns({f"{n}_diff": F.col(n) - v for n, v in expected.items()})


def snapshot(df: DataFrame, axis: Axis, price: str = "price", *, window: int = 100, bins: int = 30, delta: float = 0.005) -> DataFrame:
    """Synchrony, entropy, entropy change, curvature, Hurst exponent and phase label of each series' trailing window."""
    from tickloom.operators.aggregates import newest
    from tickloom.operators.entropy import delta_entropy, entropy, hurst
    from tickloom.operators.graph import mean_curvature, phase_flag, price_edges

    keys = list(axis.keys)
    slim = df.select(*keys, *axis.order, price)
    p = running(phase(slim, axis, price), axis, {"__back": ("count", F.lit(1), True)})
    R = p.filter(F.col("__back") <= window).groupBy(*keys).agg(kuramoto("phase").alias("R"))
    tail = newest(slim, keys, axis.order, window)
    out = R.join(entropy(tail, keys, price, bins, "H"), keys).join(delta_entropy(slim, axis, price, window, out="dH"), keys).join(
        mean_curvature(price_edges(tail, axis, price, delta), keys, "kappa"), keys, "left").join(hurst(slim, axis, price), keys)
    out = out.fillna(0.0, ["kappa"])
    return out.withColumn("phase", phase_flag(F.col("R"), F.col("dH"), F.col("kappa")))


