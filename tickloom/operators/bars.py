"""Grids, fills, interpolation, resampling and OHLCV bars."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.exprs import join_back, micros, ratio, time_bin
from tickloom.operators.axis import Axis, running, windowed

GRID_CELL = 4096


def time_grid(bounds: DataFrame, keys: Sequence[str], start: str, end: str, step: float, ts: str = "ts") -> DataFrame:
    """Every ``step`` seconds from start to end (both included) for each row of ``bounds``.

    The sequence is expanded in two levels so that no row ever holds a long array.
    """
    width = int(round(step * 1e6))
    steps = F.floor((micros(end) - micros(start)) / width)
    cells = bounds.select(*keys, micros(start).alias("__s"), steps.alias("__k")).filter(F.col("__k") >= 0).select(
        *keys, "__s", "__k", F.explode(F.sequence(F.lit(0), F.floor(F.col("__k") / GRID_CELL))).alias("__c"))
    first = F.col("__c") * GRID_CELL
    inner = F.explode(F.sequence(first, F.least(F.col("__k"), first + GRID_CELL - 1)))
    return cells.select(*keys, "__s", inner.alias("__i")).select(
        *keys, F.timestamp_micros(F.col("__s") + F.col("__i") * width).alias(ts))


def grid_of(df: DataFrame, axis: Axis, step: float) -> DataFrame:
    """The full time grid between the first and last bin of every series."""
    at = time_bin(axis.ts, step)
    bounds = df.groupBy(*axis.keys).agg(F.min(at).alias("__from"), F.max(at).alias("__to"))
    return time_grid(bounds, list(axis.keys), "__from", "__to", step, axis.ts)


def fill(df: DataFrame, axis: Axis, columns: Sequence[str], method: str = "ffill",
         zero: Sequence[str] = ()) -> DataFrame:
    """Fill NULLs of ``columns`` forward, backward or both; ``zero`` columns become 0."""
    if method == "both":
        runs = {f"__{way}_{c}": ("last", F.col(c), way == "b") for way in "fb" for c in columns}
        out = running(df, axis, runs).withColumns({c: F.coalesce(F.col(f"__f_{c}"), F.col(f"__b_{c}")) for c in columns}).drop(*runs)
    elif method in ("ffill", "bfill"):
        out = running(df, axis, {c: ("last", F.col(c), method == "bfill") for c in columns})
    else:
        raise ValueError(f"unknown fill method {method!r}")
    return out.fillna(0.0, list(zero)) if zero else out


def interpolate(df: DataFrame, axis: Axis, columns: Sequence[str], *, edges: str = "both", at: Column | None = None) -> DataFrame:
    """Linear in ``at`` (default: the axis value) between the neighbouring non-NULL values.

    ``edges="both"`` repeats the nearest value at both ends; ``"forward"`` leaves a leading gap NULL.
    """
    if at is None:
        at = F.col(axis.ts) if axis.numeric else micros(axis.ts)
    at = at.cast("double")
    point = {c: F.when(F.col(c).isNotNull(), F.struct(at.alias("t"), F.col(c).cast("double").alias("v"))) for c in columns}
    runs = {f"__{way}_{c}": ("last", point[c], way == "a") for way in "ba" for c in columns}
    both = running(df, axis, runs)
    done = {}
    for c in columns:
        b, a = F.col(f"__b_{c}"), F.col(f"__a_{c}")
        line = b["v"] + (a["v"] - b["v"]) * ratio(at - b["t"], a["t"] - b["t"], 0.0)
        lead = a["v"] if edges == "both" else F.lit(None).cast("double")
        done[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(b.isNull(), lead).when(a.isNull(), b["v"]).otherwise(line)
    return both.withColumns(done).drop(*runs)


def _rank(axis: Axis) -> Column:
    return F.struct(*axis.order) if len(axis.order) > 1 else F.col(axis.order[0])


def ohlcv(df: DataFrame, axis: Axis, step: float, *, price: str = "price", volume: str | None = "volume",
          extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Bars per series: open/high/low/close, volume, trade count and first/last trade time.

    The two times let a coarser bar be built from these bars (``rebar``).
    """
    rank = _rank(axis)
    out = df.filter(F.col(price).isNotNull()).groupBy(*axis.keys, time_bin(axis.ts, step).alias("bucket")).agg(
        F.min_by(price, rank).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, rank).alias("close"),
        *([F.sum(volume).alias("volume")] if volume else []),
        F.count(F.lit(1)).alias("trade_count"), F.min(axis.ts).alias("first_ts"), F.max(axis.ts).alias("last_ts"),
        *[v.alias(k) for k, v in (extra or {}).items()])
    return out


def rebar(bars: DataFrame, keys: Sequence[str], step: float, bucket: str = "bucket") -> DataFrame:
    """Coarser bars from finer ones."""
    return bars.groupBy(*keys, time_bin(bucket, step).alias("bucket")).agg(
        F.min_by("open", "first_ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "last_ts").alias("close"), F.sum("volume").alias("volume"),
        F.sum("trade_count").alias("trade_count"), F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"))


def bars_query(df: DataFrame, axis: Axis, step: float, *, start=None, end=None, where: Mapping[str, object] | None = None,
               limit: int | None = None) -> DataFrame:
    """Time range (end excluded) and equality filters, then bars in time order."""
    if start is not None:
        df = df.filter(F.col(axis.ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(F.col(axis.ts) < F.lit(end).cast("timestamp"))
    for column, value in (where or {}).items():
        df = df.filter(F.col(column) == F.lit(value))
    out = ohlcv(df, axis, step).orderBy("bucket", *axis.keys)
    return out.limit(limit) if limit is not None else out


def stored_bar_for(step: float, stored: Sequence[float]) -> float | None:
    """The coarsest stored bar width that divides ``step``."""
    fits = [s for s in stored if s <= step and abs(step / s - round(step / s)) < 1e-9]
    return max(fits, default=None)


def ticks_to_l1(df: DataFrame, axis: Axis, step: float, *, price: str = "price", size: str = "volume") -> DataFrame:
    """Last price and size of every bin, held forward over empty bins."""
    rank = _rank(axis)
    last = df.groupBy(*axis.keys, time_bin(axis.ts, step).alias(axis.ts)).agg(
        F.max_by(price, F.when(F.col(price).isNotNull(), rank)).alias("mid_price"),
        F.max_by(size, F.when(F.col(size).isNotNull(), rank)).alias("last_size"))
    whole = grid_of(df, axis, step).join(last, [*axis.keys, axis.ts], "left")
    return fill(whole, Axis(axis.keys, axis.ts, (), axis.grain, axis.block_rows), ["mid_price", "last_size"])


def book_resample(df: DataFrame, axis: Axis, step: float, bids: Sequence[str], asks: Sequence[str]) -> DataFrame:
    """Mean of every level column per bin with imbalance and a gap-free microprice."""
    means = df.groupBy(*axis.keys, time_bin(axis.ts, step).alias(axis.ts)).agg(
        *[F.avg(c).alias(c) for c in [*bids, *asks]])
    whole = grid_of(df, axis, step).join(means, [*axis.keys, axis.ts], "left")

    def total(cols):
        return sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols[1:]), F.coalesce(F.col(cols[0]), F.lit(0.0)))

    b, a = total(bids), total(asks)
    out = whole.withColumn("imbalance", ratio(b - a, b + a, 0.0)).withColumn(
        "microprice", ratio(F.col(bids[0]) * a + F.col(asks[0]) * b, b + a))
    flat = Axis(axis.keys, axis.ts, (), axis.grain, axis.block_rows)
    return fill(out, flat, ["microprice"], "both")


def inferred_steps(df: DataFrame, axis: Axis) -> DataFrame:
    """(keys, ``__step``): the cadence in microseconds of the series of at least three rows whose steps are all equal."""
    return infer_step(df, axis).where("step_us is not null and rows >= 3").select(*axis.keys, F.col("step_us").cast("long").alias("__step"))


def normalize_market(df: DataFrame, axis: Axis, step: float | None, *, kind: str = "tick", method: str = "ffill",
                     price: str = "price", volume: str = "volume") -> DataFrame:
    """Deduplicated, gap-free OHLCV of each series with a ``missing`` flag on bins no data fell in.

    Ticks: one price per bin (the last), so open = high = low = close; volume is the bin's sum. ``kind="ohlcv"`` takes bars as they are. ``method`` fills prices: ``ffill``, ``bfill``, ``interpolate``
    or ``none``. Without a ``step`` each series has its own cadence if all its steps are equal and it has three rows; other series cannot be put on a grid and are left out (``inferred_steps`` lists those that can).
    """
    keys = list(axis.keys)
    unique = keep_last(df, [*keys, axis.ts], axis.seq)
    flat = Axis(axis.keys, axis.ts, (), axis.grain, axis.block_rows)
    if step is None:
        steps = inferred_steps(unique, flat)
        unique = join_back(unique, steps, keys)
        own = F.timestamp_micros(micros(axis.ts) - F.pmod(micros(axis.ts), F.col("__step")))
    if kind == "tick":
        rank = _rank(axis)
        binned = unique.groupBy(*keys, (time_bin(axis.ts, step) if step else own).alias(axis.ts)).agg(
            F.max_by(price, F.when(F.col(price).isNotNull(), rank)).alias("close"), F.sum(volume).alias("volume"))
        binned = binned.filter(F.col("close").isNotNull()).select(
            *keys, axis.ts, F.col("close").alias("open"), F.col("close").alias("high"),
            F.col("close").alias("low"), "close", F.coalesce("volume", F.lit(0.0)).alias("volume"))
    else:
        binned = unique.select(*keys, axis.ts, "open", "high", "low", "close", "volume")
    if step:
        grid = grid_of(binned, flat, step)
    else:
        ends = join_back(binned.groupBy(*keys).agg(F.min(micros(axis.ts)).alias("__from"), F.max(micros(axis.ts)).alias("__to")), steps, keys)
        grid = ends.select(*keys, F.explode(F.sequence("__from", "__to", "__step")).alias("__us")).select(*keys, F.timestamp_micros("__us").alias(axis.ts))
    whole = grid.join(binned.withColumn("__seen", F.lit(True)), [*keys, axis.ts], "left")
    whole = whole.withColumn("missing", F.col("__seen").isNull()).drop("__seen")
    prices = ["open", "high", "low", "close"]
    if method == "none":
        return whole
    if method == "interpolate":
        done = interpolate(whole, flat, prices, edges="forward")
    else:
        done = fill(whole, flat, prices, method)
    return done.fillna(0.0, ["volume"])


def normalization_report(raw: DataFrame, normalized: DataFrame, axis: Axis, method: str = "ffill") -> DataFrame:
    """Rows, span, duplicates dropped, missing and filled intervals per series."""
    keys = list(axis.keys)
    distinct = raw.select(*keys, axis.ts).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("__d"))
    dup = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).join(distinct, keys).select(
        *keys, (F.col("__n") - F.col("__d")).alias("duplicates_dropped"))
    rep = normalized.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min(axis.ts).alias("start"), F.max(axis.ts).alias("end"),
        F.count_if(F.col("missing")).alias("missing_intervals"))
    filled = F.lit(0).cast("long") if method == "none" else F.col("missing_intervals")
    return rep.withColumn("filled_intervals", filled).join(dup, keys)


def infer_step(df: DataFrame, axis: Axis) -> DataFrame:
    """Cadence of each series in microseconds, NULL unless all steps are equal."""
    def build(d, w):
        return d.withColumn("__d", micros(axis.ts) - F.lag(micros(axis.ts)).over(w))

    steps = windowed(df.select(*axis.keys, *axis.order), axis, build, back=1)
    return steps.groupBy(*axis.keys).agg(
        F.when(F.min("__d") == F.max("__d"), F.min("__d")).alias("step_us"),
        F.count(F.lit(1)).alias("rows"))


def multi_timeframe(df: DataFrame, axis: Axis, steps: Mapping[str, float], price: str = "price") -> DataFrame:
    """Last price per bin of several widths in one pass, held forward; one row per (key, timeframe, bin)."""
    frames = F.explode(F.array(*[F.struct(F.lit(n).alias("timeframe"), F.lit(int(s * 1e6)).alias("w"))
                                 for n, s in steps.items()]))
    at = micros(axis.ts)
    tall = df.select(*axis.keys, *axis.order, price, frames.alias("f")).select(
        *axis.keys, "f.timeframe", "f.w", *axis.order, price).withColumn(
        "bucket", F.timestamp_micros(at - F.pmod(at, F.col("w"))))
    keys = [*axis.keys, "timeframe"]
    last = tall.groupBy(*keys, "w", "bucket").agg(F.max_by(price, _rank(axis)).alias(price))
    span = last.groupBy(*keys, "w").agg(F.min("bucket").alias("__from"), F.max("bucket").alias("__to"))
    whole = None
    for name, s in steps.items():
        part = time_grid(span.filter(F.col("timeframe") == name), keys, "__from", "__to", s, "bucket")
        whole = part if whole is None else whole.unionByName(part)
    joined = whole.join(last.drop("w"), [*keys, "bucket"], "left")
    return fill(joined, Axis(keys, "bucket", (), axis.grain, axis.block_rows), [price])


def sliding_windows(df: DataFrame, axis: Axis, column: str, window: int, step: int = 1) -> DataFrame:
    """Arrays of ``window`` consecutive values, one every ``step`` rows of the series."""
    from tickloom.operators.axis import row_numbers

    numbered = row_numbers(df, axis, "__pos")

    def build(d, w):
        return d.withColumn("values", F.collect_list(column).over(w.rowsBetween(-(window - 1), 0)))

    out = windowed(numbered, axis, build, back=window - 1 or 1)
    start = F.col("__pos") - window
    return out.filter((start >= 0) & (start % step == 0)).withColumn(
        "start", start.cast("long")).drop("__pos")


def convolve(df: DataFrame, axis: Axis, column: str, kernel: Sequence[float], mode: str = "same") -> DataFrame:
    """Discrete convolution with a short kernel: ``conv`` per row (``valid`` keeps complete overlaps only).

    ``full`` adds the rows past the end with a NULL axis value and ``pos`` continuing the count.
    """
    from tickloom.operators.axis import row_numbers

    m = len(kernel)
    numbered = row_numbers(df.select(*axis.keys, *axis.order, column), axis, "pos")
    numbered = numbered.withColumn("pos", F.col("pos") - 1)
    if mode == "full" and m > 1:
        ends = numbered.groupBy(*axis.keys).agg(F.max("pos").alias("__p"), F.max(axis.ts).alias("__t"))
        pad = ends.select(*axis.keys, F.col("__t").alias(axis.ts), F.explode(
            F.sequence(F.col("__p") + 1, F.col("__p") + m - 1)).alias("pos"))
        numbered = numbered.unionByName(pad, allowMissingColumns=True)
    shift = (m - 1) // 2 if mode == "same" else 0
    by_pos = Axis(axis.keys, "pos", (), grain=4096.0, block_rows=axis.block_rows, numeric=True)

    def build(d, w):
        terms = []
        for j, k in enumerate(kernel):
            off = j - shift
            v = F.lag(column, off).over(w) if off > 0 else F.lead(column, -off).over(w) if off < 0 else F.col(column)
            terms.append(F.coalesce(v, F.lit(0.0)) * F.lit(float(k)))
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return d.withColumn("conv", total)

    out = windowed(numbered, by_pos, build, back=max(m - 1, 1), fwd=max(shift, 1))
    return out.filter(F.col("pos") >= m - 1) if mode == "valid" else out


def keep_last(df: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """One row per key: the last by ``seq``, as a combining aggregate (no window over hot copies)."""
    rest = [c for c in df.columns if c not in keys]
    if not seq:
        return df.dropDuplicates(list(keys))
    row = F.max_by(F.struct(*rest), F.struct(*seq))
    return df.groupBy(*keys).agg(row.alias("__r")).select(*keys, "__r.*").select(*df.columns)
